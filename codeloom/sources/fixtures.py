"""The engine's tables derived from star-schema Parquet, so that every graph query can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import is_test_path
from codeloom.operators.graph import in_round, in_rounds, rounds, tidied
from codeloom.schemas import MODULE

#: Lines of orders that are sorted at a time, and pairs that meet their symbols at a time.
LINES, PAIRS = 6_000_000, 1_000_000
#: Words of 64 bits that tell which orders have a call: the length of a broadcast table.
WORDS = 1 << 17


class Fixtures:
    """Symbols from ``part``; calls, imports and edges from neighbouring lines of orders. ``fine`` makes names rarer."""

    def __init__(self, spark: SparkSession, sf_dir: str, fine: bool = False):
        self.spark, self.dir, self.fine = spark, sf_dir, fine

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def symbols(self) -> DataFrame:
        p = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
        name = F.translate("p_name", " ", "_")
        if self.fine:
            name = F.concat(name, F.lit("_"), (F.col("p_partkey") % 97).cast("string"))
        owner = F.initcap(F.lower("p_type"))
        path = F.concat(F.when(F.col("p_size") % 10 == 0, "tests/").otherwise("src/"), F.lower(F.translate("p_brand", "#", "_")), F.lit("/mod_"), F.col("p_size").cast("string"), F.lit(".py"))
        plain = F.col("p_type") == "STANDARD"
        order = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
        s = p.select("p_partkey", name.alias("name"), F.when(plain, name).otherwise(F.concat(owner, F.lit("."), name)).alias("qualname"), F.when(plain, "function").otherwise("method").alias("kind"), path.alias("path"), (10 * F.row_number().over(order)).alias("start_line"), "p_retailprice")
        nth = F.row_number().over(Window.partitionBy("path", "qualname").orderBy("start_line"))
        s = s.withColumn("nth", nth).withColumn("id", F.concat("path", F.lit("::"), "qualname", F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth").cast("string"))).otherwise("")))
        typed = F.expr("array('Small', 'Large', 'Medium', 'Economy', 'Promo')[cast(p_partkey % 5 as int)]")
        params = F.when(F.col("p_partkey") % 3 == 0, F.array(F.struct(F.lit("ring").alias("name"), F.concat(F.lit("Optional["), typed, F.lit("]")).alias("type")))).otherwise(F.array().cast("array<struct<name: string, type: string>>"))
        return s.select("p_partkey", "id", "name", "qualname", "kind", "path", F.lit("python").alias("language"), params.alias("params"), F.when(F.col("p_partkey") % 4 == 0, "int").alias("returns"), "start_line", (F.col("start_line") + 8).alias("end_line"), (F.col("p_partkey") % 11 == 0).alias("decorated"), (F.col("p_partkey") % 13 == 0).alias("exported"), F.lit(None).cast("string").alias("doc"), is_test_path(F.col("path")).alias("test"), "p_retailprice")

    def paired(self) -> Fixtures:
        """The same with its pairs written once, some orders after others: each table that is derived from them sorts all
        lines of orders else."""
        out = Fixtures(self.spark, self.dir, self.fine)
        lines = self.table("lineitem")
        n = rounds(lines, LINES)
        pairs = in_rounds(n, lambda k: self.pairs(self.calling(lines.where(in_round("l_orderkey", k, n)))))
        out.pairs = lambda: pairs
        return out

    def written(self) -> Fixtures:
        """``paired``, with symbols written once too, and module edges made of some callees after others."""
        out = self.paired()
        symbols, pairs = tidied(out.symbols()), out.pairs()
        out.symbols = lambda: symbols
        n = rounds(pairs, PAIRS)
        edges = in_rounds(n, lambda k: out.edges_of(pairs.where(in_round("dst", k, n))))
        out.module_edges = lambda: edges
        return out

    def calling(self, lines: DataFrame) -> DataFrame:
        """All lines of the orders that have a call, and of the few others whose keys share a bit with one of theirs: most
        lines of orders make no pair, and needn't be sorted."""
        bit = F.pmod(F.xxhash64("l_orderkey", F.lit(1)), F.lit(64 * WORDS))
        lines = lines.withColumns({"word": F.floor(bit / 64), "bit": (bit % 64).cast("int")})
        words = lines.where("l_quantity >= 46").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        return lines.join(F.broadcast(words), "word").where("shiftrightunsigned(bits, bit) & 1 = 1").drop("word", "bit", "bits")

    def pairs(self, lines: DataFrame | None = None) -> DataFrame:
        """Of ``lines``, whole orders; of all, if not given."""
        lines = (self.table("lineitem") if lines is None else lines).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return lines.withColumn("dst", F.lead("l_partkey").over(order)).where("dst IS NOT NULL AND l_quantity >= 46").select(F.col("l_partkey").alias("src"), "dst", (F.col("l_orderkey") % 500 + 1).cast("int").alias("line"), "l_returnflag", "l_discount")

    def named_pairs(self, pairs: DataFrame | None = None) -> DataFrame:
        s = self.symbols()
        a, b = (s.select(F.col("p_partkey").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("id", "name", "path", "qualname"))) for k in ("src", "dst"))
        return (self.pairs() if pairs is None else pairs).join(a, "src").join(b, "dst")

    def raw_edges(self) -> DataFrame:
        return self.named_pairs().where("src <> dst").select(F.col("src_id").alias("caller"), F.col("dst_id").alias("callee"), "line")

    def module_edges(self) -> DataFrame:
        """Edges of which some come from the top level of a file."""
        return self.edges_of()

    def edges_of(self, pairs: DataFrame | None = None) -> DataFrame:
        caller = F.when(F.col("line") % 50 != 0, F.col("src_id")).otherwise(F.concat("src_path", F.lit(MODULE)))
        found = self.named_pairs(pairs).select(caller.alias("caller"), F.col("dst_id").alias("callee"), "line").where("caller <> callee")
        return found.groupBy("caller", "callee").agg(F.array_sort(F.collect_set("line")).alias("lines"))

    def described(self) -> DataFrame:
        """Files of the symbols, with a doc."""
        s = self.symbols().select("path").distinct()
        return s.select("path", F.lit("python").alias("language"), F.concat(F.lit("Handles "), "path", F.lit(" and whatever else belongs to it in the folder of its brand")).alias("doc"))

    def source_lines(self) -> DataFrame:
        """Lines 1 to 500 of every file."""
        s = self.symbols().select("path").distinct()
        return s.select("path", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("line")).withColumn("text", F.concat(F.lit("    line "), F.col("line").cast("string")))

    def imports(self) -> DataFrame:
        dotted = F.translate(F.regexp_replace("dst_path", r"\.py$", ""), "/", ".")
        d = self.named_pairs().where("l_discount >= 0.05").select(F.col("src_path").alias("path"), F.col("dst_name").alias("name"), F.concat(dotted, F.lit("."), F.col("dst_name")).alias("source")).distinct()
        return d.withColumn("ordinal", F.row_number().over(Window.partitionBy("path", "name").orderBy("source")))

    def raw_calls(self) -> DataFrame:
        receiver = F.when(F.col("l_returnflag") == "A", "self").when(F.col("l_returnflag") == "R", "ring")
        return self.named_pairs().select(F.when(F.col("line") % 50 != 0, F.col("src_id")).alias("caller_id"), F.col("src_path").alias("path"), F.concat_ws(".", receiver, "dst_name").alias("text"), F.col("dst_name").alias("name"), receiver.alias("receiver"), "line")

    def files(self) -> DataFrame:
        d = self.table("documents")
        doc = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
        return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), doc.alias("doc"), F.col("n_chars").alias("size"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), "doc_id")

    def external(self) -> DataFrame:
        found = self.table("pages").select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("callee"))
        return found.select(F.concat("url", F.lit(MODULE)).alias("caller"), "callee", F.length("callee").alias("line"))

    def commits(self) -> DataFrame:
        """Files touched by commits: users stand for parts."""
        n = self.table("part").agg(F.count("*").alias("n"))
        s = self.symbols().select("p_partkey", "path")
        e = self.table("events").select("event_id", "user_id", "ts").crossJoin(F.broadcast(n)).withColumn("p_partkey", F.col("user_id") % F.col("n"))
        return e.join(s, "p_partkey").select(F.col("event_id").alias("commit_id"), "path", "ts")

    def transcript(self) -> DataFrame:
        """Session records: usage follows the length of the text; tools read files of symbols by number."""
        c = self.table("conversations")
        use = F.when(F.col("role") == "assistant", F.length("text"))
        return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.when(F.col("turn") % 7 != 3, use).alias("usage"), F.floor(F.length("text") / 4).alias("estimate"), ((F.col("conv_id") * 31 + F.col("turn")) % 2000).alias("part"), F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.col("turn") * 10).cast("int").alias("offset"), F.when(F.col("turn") % 3 == 2, F.lit(30)).alias("limit"))

    def notes(self) -> DataFrame:
        n = self.table("labels").select(F.col("doc_id").alias("p_partkey"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
        s = self.symbols().select("p_partkey", "id")
        return n.join(s, "p_partkey", "left").select(F.coalesce("id", F.concat(F.lit("gone::"), F.col("p_partkey").cast("string"))).alias("symbol_id"), "text")
