"""The pipeline on a small table, stage by stage."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    text = lambda i: "\n".join(" ".join(f"word{i}x{j}x{k}" for k in range(20)) for j in range(6))
    near = text(1).replace("word1x3x5", "changed")
    rows = [(i, text(i), "en", "s", 0) for i in range(8)] + [(20, text(2), "en", "s", 0), (21, near, "en", "s", 0), (22, "too short", "en", "s", 0), (23, text(23) + "\npassword = hunter2hunter2", "en", "s", 0), (24, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 22 not in seen["quality rules"] and 24 not in seen["quality rules"] and 20 in seen["quality rules"]
    assert 20 not in seen["line dedup"] and 21 not in seen["line dedup"]  # every line repeats an earlier one
    assert "hunter2" not in seen["secret scan"][23] and set(seen["secret scan"]) == {*range(8), 23}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {*range(8), 23}


def test_copies_leave_no_short_lines(spark, tmp_path):
    """A later exact copy goes whole, its lines of a few words and its blank ones included."""
    long = lambda i, j: " ".join(f"word{i}x{j}x{k}" for k in range(20))
    text = lambda i: "\n".join(f"{long(i, j)}\n\nheading {i} {j}" for j in range(4))
    rows = [(i, text(i), "en", "s", 0) for i in range(4)] + [(10, text(2), "en", "s", 0), (11, text(3), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert left == {i: text(i) for i in range(4)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(4))
