"""Review addresses against a plain reader, unresolved references in their order, and differences that round to nothing."""

from urllib.parse import urlsplit

import pytest

from tidemark.operators import findings, text_rules  # noqa: F401
from tidemark.plans.relation import RELATIONS

SLUG = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")


def reader(url):
    """Provider, host, project, number and address by reading the parts in turn; None for what isn't a review."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or set(host) - SLUG | set("_") & set(host):
        return None
    steps = parts.path.split("/")[1:]
    steps = steps[:-1] if steps and steps[-1] == "" else steps
    for provider, marker, tails in (("github", ["pull"], {"files", "commits", "checks"}), ("gitlab", ["-", "merge_requests"], {"diffs", "commits", "changes", "pipelines"})):
        own = steps[:-1] if steps and steps[-1] in tails else steps
        if len(own) > len(marker) + 1 and own[-1].isdigit() and own[-1][0] != "0" and own[-1 - len(marker) : -1] == marker:
            project = own[: -1 - len(marker)]
            if (len(project) == 2 or provider == "gitlab") and all(p and not set(p) - SLUG and p not in (".", "..") for p in project):
                host += f":{port}" if port else ""
                name = "/".join(project)
                return provider, host, name, int(own[-1]), f"{parts.scheme}://{host}/{name}/{'/'.join(marker)}/{own[-1]}"
    return None


URLS = [
    a + b + c + d for a in ("https://", "HTTP://", "ftp://", "https://u:p@", "https://u@", "https://:p@", "https://@", " https://") for b in ("GitHub.com", "h.example:8443", "h:0", "h:99999", "h:", "h:8x", "h_x", "")
    for c in ("/o/r/pull/12", "/a/b/c/-/merge_requests/3", "/o/r/pull/012", "/o/../pull/1", "/o/r/x/pull/1", "/g/-/merge_requests/4", "/o/r/pull/5/files/", "/o/r/pull/5/diffs", "/a//b/-/merge_requests/2", "/o/r/pulls/1", "") for d in ("", "?x=1", "#d", "?a#/pull/3")
]


def test_addresses_agree_with_a_plain_reader(spark):
    rows = RELATIONS["review_url"].over(ev_urls=spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()
    got = {r.page_id: (r.provider, r.host, r.project, r.request_id, r.url) if r.provider else None for r in rows}
    wrong = [(u, got[k], reader(u)) for k, u in enumerate(URLS) if got[k] != reader(u)]
    assert not wrong, wrong[:5]
    assert 100 < sum(v is not None for v in got.values()) < len(URLS) - 100


def test_unresolved_references_name_the_first_two_contexts_in_order(spark):
    said = lambda x: f"PHPStan class.notFound: {x} (snapshot level 5)"
    rows = [("s", 1, "phpstan.return.type", "b.php", 3, "other"), ("s", 2, "phpstan.class.notFound", "a.php", 4, "no context"), ("s", 3, "phpstan.class.notFound", "a.php", 4, said("zz: first"))]
    rows += [("s", 4, "phpstan.class.notFound", "a.php", 5, said("yy")), ("s", 5, "phpstan.class.notFound", "a.php", 6, said("zz: first")), ("s", 6, "phpstan.class.notFound", "a.php", 6, said("aa")), ("s", 7, "phpstan.trait.notFound", "t.php", 9, said("alone"))]
    rows += [("t", 1, "phpstan.class.notFound", "a.php", 1, said("x" * 200)), ("t", 2, "phpstan.class.notFound", "a.php", 2, "none")]
    df = spark.createDataFrame(rows, "snapshot_id string, ord long, rule string, path string, line long, message string")
    got = {(r.snapshot_id, r.ord): (r.path, r.line, r.n, r.message) for r in RELATIONS["unresolved_groups"].over(ev_reports=df).collect()}
    text = "PHPStan class.notFound: {} unresolved references; may reflect unavailable dependencies or local errors (snapshot level 5)"
    assert got == {
        ("s", 1): ("b.php", 3, 1, "other"), ("s", 2): ("", 0, 5, text.format(5) + "; examples: zz: first | yy"), ("s", 7): ("t.php", 9, 1, said("alone")), ("t", 1): ("", 0, 2, text.format(2)),
    }


@pytest.mark.parametrize(("head", "raised"), [(10.00001, 0), (10.00006, 1), (9.99999, 0), (10.0, 0), (11.0, 1)])
def test_a_difference_that_rounds_to_nothing_is_no_change(spark, head, raised):
    columns = RELATIONS["stage_messages"]
    stage = lambda side, cc: {f"{side}_status": "ok", f"{side}_required": True, f"{side}_category": "complexity", f"{side}_max_cc": cc, f"{side}_gap": False}
    import re

    names = sorted(set(re.findall(r"\b(?:base|head)_\w+", columns.sql)) | {"snapshot_id", "stage_id", "note", "alike", "added", "resolved", "ambiguous", "uncertain"} | set(re.findall(r"\b\w+_rules\b|\bmeasures\b", columns.sql)))
    kind = lambda c: "string" if c in ("snapshot_id", "stage_id", "note") or c.endswith(("_status", "_category")) else "array<string>" if c.endswith("_rules") or c == "measures" else "boolean" if c in ("alike",) or c.endswith(("_required", "_gap", "_file", "_readme", "_files")) else "double"
    row = {"snapshot_id": "s", "stage_id": "cc", "note": "", "alike": True, "added": 0.0, "resolved": 0.0, "ambiguous": 0.0, "uncertain": 0.0} | stage("base", 10.0) | stage("head", head)
    df = spark.createDataFrame([tuple(row.get(c) for c in names)], ", ".join(f"{c} {kind(c)}" for c in names))
    said = columns.over(stage_deltas=df).first().said
    assert sum(x.kind == "regression" for x in said) == raised and not [x for x in said if x.kind == "improvement"]
