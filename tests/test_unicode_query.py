"""The registered query finds every control of whole texts."""

from tidemark.plans import registry


def test_every_control_of_a_long_text_is_found(spark, tmp_path):
    long = "a" * 60 + "\n" + "b" * 100_100 + "\u202d tail"
    rows = [(7, long), (1, "x\u200by\n\ufeffz\u2066\u00ad"), (2, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in registry.QUERIES["q_unicode_controls"](spark, f"file://{tmp_path}").collect())
    assert found == sorted([
        (7, "unicode.unexpected-joiner", "low", 1, 51, "U+200D"), (7, "unicode.bidi-control", "high", 2, 100_101, "U+202D"),
        (1, "unicode.invisible-control", "low", 1, 2, "U+200B"), (1, "unicode.misplaced-bom", "low", 2, 1, "U+FEFF"),
        (1, "unicode.bidi-control", "medium", 2, 3, "U+2066"), (1, "unicode.soft-hyphen", "info", 2, 4, "U+00AD"),
    ])


def test_a_text_full_of_controls_takes_time_in_proportion(spark):
    import time

    from tidemark.operators import text_rules

    line = "word ‍ other‮ line\n"
    took = []
    for n in (1, 100_000):
        began = time.perf_counter()
        rows = text_rules.unicode_controls(spark.createDataFrame([(1, line * n)], "doc_id long, text string"))
        assert rows.count() == 2 * n and rows.agg({"line": "max"}).first()[0] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 60  # 1.9 million characters; a copy of what came before each control would take an hour
