"""Rules over token rows: the sample lines, each in a file of its own, and random tokens against a reader of one token after
the other."""

import random
from collections import Counter

from tidemark.operators import token_rules as T

SCHEMA = "path string, seq long, kind string, text string, line long"


def findings(spark, files):
    rows = [(p, i, k, t, 1) for p, tokens in files.items() for i, (k, t) in enumerate(tokens)]
    return Counter((r.path, r.seq, r.rule.removeprefix("security.php."), r.severity) for r in T.token_findings(spark.createDataFrame(rows, SCHEMA)).collect())


def test_each_sample_line(spark):
    files = {str(k): [("T_OPEN_TAG", "<?php"), *T.sample_tokens(code)] for k, (code, *_) in enumerate(T.SAMPLES)}
    assert findings(spark, files) == Counter((str(k), i + 1, rule, severity) for k, (_, i, rule, severity) in enumerate(T.SAMPLES) if rule)


class Reader:
    """The rules by walking over the tokens."""

    def __init__(self, tokens):
        self.t = [(i, k, x) for i, (k, x) in enumerate(tokens) if k not in T.IGNORED]
        self.known, at = set(), 0
        while at + 1 < len(self.t):
            if self.t[at][1] == "T_VARIABLE" and self.t[at + 1][2] == "=":
                end = self.until(at + 2)
                if self.tainted(self.t[at + 2 : end]):
                    self.known.add(self.t[at][2])
                at = end
            else:
                at += 1

    def until(self, at):
        while at < len(self.t) and self.t[at][2] != ";":
            at += 1
        return at

    def tainted(self, part):
        return any(x in T.REQUEST or x in self.known or k == "T_STRING" and x.lower() in T.REQUEST_CALLS for _, k, x in part)

    def close(self, part, at):
        depth = 0
        for j in range(at, len(part)):
            depth += (part[j][2] in "([{") - (part[j][2] in ")]}") if len(part[j][2]) == 1 else 0
            if depth == 0:
                return j
        return None

    def split(self, at):
        if at >= len(self.t) or self.t[at][2] != "(" or (end := self.close(self.t, at)) is None:
            return None
        out, depth = [[]], 0
        for token in self.t[at + 1 : end]:
            depth += (token[2] in "([{") - (token[2] in ")]}") if len(token[2]) == 1 else 0
            if token[2] == "," and depth == 0:
                out.append([])
            else:
                out[-1].append(token)
        return out

    def argument(self, args, nth, name):
        plain = []
        for a in args:
            label = a[0][2] if len(a) > 1 and a[0][1] == "T_STRING" and a[1][2] == ":" else None
            if label == name:
                return a[2:]
            if label is None:
                plain.append(a)
        return plain[nth] if nth < len(plain) else []

    def dynamic(self, part):
        at = 0
        while at < len(part):
            _, k, x = part[at]
            if k in ("T_STRING", "T_NAME_FULLY_QUALIFIED") and x.lower().lstrip("\\") == "escapeshellarg" and at + 1 < len(part) and part[at + 1][2] == "(" and (end := self.close(part, at + 1)) is not None:
                at = end + 1
                continue
            if k in T.DYNAMIC:
                return True
            at += 1
        return False

    def harmless(self, part):
        x = [t[2] for t in part]
        inner = part[1:-1] if len(x) > 1 and x[0] == "[" and x[-1] == "]" else part[2:-1] if len(x) > 2 and x[0].lower() == "array" and x[1] == "(" and x[-1] == ")" else []
        inner = inner[:-1] if inner and inner[-1][2] == "," else inner
        return len(inner) == 3 and inner[0][1] == "T_CONSTANT_ENCAPSED_STRING" and inner[0][2][1:-1] == "allowed_classes" and inner[1][2] == "=>" and inner[2][2].lower() == "false"

    def found(self):
        tick = None
        for at, (seq, kind, text) in enumerate(self.t):
            before = self.t[at - 1][2] if at else ""
            name = text.lower().lstrip("\\")
            if kind == "T_EVAL":
                yield seq, "eval", "high"
            if kind in T.INCLUDES:
                part = [t for t in self.t[at + 1 : self.until(at + 1)] if t[2] not in "()"]
                if not part or not all(k in ("T_CONSTANT_ENCAPSED_STRING", "T_DIR", "T_FILE") or x == "." for _, k, x in part):
                    yield seq, "variable-include", "high" if self.tainted(part) else "medium"
            if kind in ("T_STRING", "T_NAME_FULLY_QUALIFIED") and (args := self.split(at + 1)) is not None:
                free = before not in ("->", "?->", "::", "function", "new")
                if name == "unserialize" and free and self.tainted(self.argument(args, 0, "data")) and not self.harmless(self.argument(args, 1, "options")):
                    yield seq, "request-unserialize", "high"
                if name == "extract" and free:
                    yield seq, "extract", "high" if self.tainted(self.argument(args, 0, "array")) else "medium"
                if name in T.SHELL and free:
                    if self.dynamic(self.argument(args, 0, "command")):
                        yield seq, "dynamic-shell", "high"
                elif name in T.SQL and before in ("->", "?->", "::") and any(t[2] == "." for t in args[0]) and any(t[1] == "T_VARIABLE" for t in args[0]):
                    yield seq, "concatenated-sql", "medium"
            if text == "`":
                if tick is None:
                    tick = at
                else:
                    if self.dynamic(self.t[tick + 1 : at]):
                        yield self.t[tick][0], "dynamic-shell", "high"
                    tick = None


def test_random_tokens_agree_with_a_reader(spark):
    rng, files = random.Random(8), {}
    pieces = ["unserialize(", "exec(", "system(", "extract(", "$db->query(", "DB::raw(", "escapeshellarg(", "array(", "f(", "[", "{", ")", ")", ")", "]", "}", ",", ",", ";", "$a", "$b", "$_GET", "'x'", "'allowed_classes'=>false", "['allowed_classes'=>false]", ".", "data:", "options:", "command:", "array:", "$a=", "$b=", "=", "input", "eval", "include", "new", "`", "->", "\\exec("]
    for k in range(400):
        files[f"r{k}"] = [t for _ in range(rng.randrange(2, 40)) for t in T.sample_tokens(rng.choice(pieces))]  # ticks may hold any tokens
    whole = [t for k in range(400) for t in files[f"r{k}"]]
    files["hot"] = whole
    expected = Counter((p, *f) for p, tokens in files.items() for f in Reader(tokens).found())
    got = findings(spark, files)
    assert got == expected, (got - expected, expected - got)
    assert len({k[2] for k in got}) == 6 and sum(got.values()) > 200


def test_tokens_are_dealt_by_file_only(spark):
    from tidemark.plans.registry import QUERIES

    plan = QUERIES["q_token_findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in plan


def test_an_argument_under_escaping_calls_and_a_file_without_a_path(spark):
    codes = ["escapeshellarg(exec(escapeshellarg($a) . $b, $c));", "escapeshellarg(exec(escapeshellarg($a), $c));", "` escapeshellarg(escapeshellarg($a)) `;", "` escapeshellarg( ` $a );", "require 'a' . $b", "exec($a"]
    files = {str(k): [(kind, text) for kind, text in (("", "`") if t == "`" else (kd, t) for c in code.split("`") for kd, t in [*T.sample_tokens(c), ("", "`")])][:-1] for k, code in enumerate(codes)}
    files[None] = T.sample_tokens("eval($a); exec($b);")
    assert findings(spark, files) == Counter((p, *f) for p, tokens in files.items() for f in Reader(tokens).found())
