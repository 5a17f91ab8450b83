"""Secret catalogs, columns in other units, compiler diagnostics and declarations."""

from pyspark.sql import functions as F

from tidemark.operators import locations, secrets

CATALOG = """
[allowlist]
regexes = ['''^\\$\\{[A-Z_]+\\}$''']
stopwords = ["abcdefghijklmnop"]
[[rules]]
id = "token"
regex = '''tok_([A-Za-z0-9]{16})'''
keywords = ["tok_"]
entropy = 3.0
secretGroup = 1
[[rules]]
id = "in-config"
regex = '''key=([[:alnum:]]+)'''
keywords = ["key"]
path = '''\\.cfg$'''
"""


def test_a_catalog_finds_places_and_never_matches(spark, tmp_path):
    (tmp_path / "rules.toml").write_text(CATALOG)
    value = "A1b2" + "C3d4E5f6" + "G7h8"
    texts = spark.createDataFrame(
        [("a.py", f"x\r\ny = tok_{value}\n"), ("b.py", "tok_" + "a" * 16), ("c.py", "TOK_ nothing"), ("d.py", "tok_abcdefghijklmnop"), ("e.cfg", "key=zz"), ("e.py", "key=zz")],
        "relative_path string, content string",
    )
    rows = secrets.scan(texts, secrets.rules(spark, str(tmp_path / "rules.toml")))
    assert sorted((r.relative_path, r.line, r.rule, r.severity) for r in rows.collect()) == [("a.py", 2, "secret.token", "high"), ("e.cfg", 1, "secret.in-config", "high")]
    assert not any(value in str(r) for r in rows.collect())


def test_columns_in_other_units(spark):
    rows = spark.createDataFrame([("",), ("ab",), ("é😀",), ("a\tb\t",)], "before string")
    got = rows.select(locations.utf16_column(F.col("before")), locations.byte_column(F.col("before")), locations.tab_column(F.col("before"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (3, 3, 3), (4, 7, 4), (5, 5, 17)]


def test_diagnostics_are_tied_by_path_or_unique_name(spark):
    files = spark.createDataFrame([("src/A.java",), ("x/B.java",), ("y/B.java",)], "relative_path string")
    lines = spark.createDataFrame([("src/A.java:3:4: compiler.err.cant.resolve: x",), ("A.java:5:1: compiler.warn.raw",), ("B.java:1:1: compiler.err.doesnt.exist",), ("1 error",)], "text string")
    rows = {(r.path, r.line, r.severity, r.dependency) for r in locations.javac_diagnostics(lines, files).collect()}
    assert rows == {("src/A.java", 3, "medium", False), ("src/A.java", 5, "low", False), (None, 1, "medium", True)}


def test_only_ellipsis_declarations_may_be_missing(spark):
    source = 'class A:\n    def f(self): ...\n    def g(self):\n        """Doc."""\n        ...\n    def h(self):\n        return 1\n'
    files = spark.createDataFrame([("a.py", source)], "relative_path string, content string")
    rows = locations.missing_declarations(files, spark.createDataFrame([("b.py", 1)], "path string, line long")).collect()
    assert {(r.function, r.reconciled) for r in rows} == {("A.f", True), ("A.g", True), ("A.h", False)}


def test_history_has_its_own_production_filter(spark):
    paths = {"a.py": True, "testing/a.py": False, "x/migrations/b.py": False, "test_a.py": False, "a_test.py": False, "a.pyi": False}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", locations.production_python().alias("k"))
    assert {r.path: r.k for r in rows.collect()} == paths


def test_only_whole_words_are_placeholders(spark):
    from tidemark.operators import text_rules

    lines = ["token: examplecorp-live-9f8e7d6c5b4a", "token: my-example-token-1234", "aws_secret_access_key = A1b2C3d4E5f6G7h8", "password=your_password_here", "api_key='xxxxxxxxxxxxxxxx'", "secret: dummyville00001", "passwd = CHANGE_ME_please_now"]
    found = text_rules.secret_scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [0, 2, 5]
