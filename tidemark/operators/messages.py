"""Messages of tools, made fit to publish (F-22, F-23), as one expression over a text column.

F-22: paths, addresses' user parts and long or credential-like words are replaced first. Then the text is cut into quoted
parts and what stands between them; quotes that don't pair up, stand inside a quoted part or touch a word make the whole
message unsafe. A quoted part stays if it is a type, or a name or module where the words before it announce one; all others
are replaced, as is markup between them. F-23: a message stays only if it is, as a whole, one of the known sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.relation import relation

MOST_READ, MOST_SAID, MOST_PHP = 4096, 512, 300
# What is said of an unsafe message, what credentials begin with, the types' names, and which words announce
# a name.
UNSAFE = "Native diagnostic text withheld because quoting was unsafe"
CREDENTIAL = r"(?:gh[pousr]_|github_pat_|sk[-_]|AKIA)"
TYPES = ("string", "number", "boolean", "bigint", "symbol", "object", "any", "unknown", "never", "void", "undefined", "null")
ANNOUNCED = r"(?:[Pp]arameter|[Pp]roperty|[Nn]ame|[Mm]odule|[Nn]amespace|[Mm]ember|[Cc]lass|[Ii]nterface) \z| does not exist on type \z"
IDENTIFIER = r"\A[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\z"
MODULE = r"\A(?:@[a-zA-Z0-9_-]+/)?[a-zA-Z0-9_.-]+(?:/[a-zA-Z0-9_.-]+)*\z"
QUOTED = r"'[^']*'|\"[^\"]*\"|`[^`]*`"
MARKUP = r"\[path\]|\[redacted\]|<[^>]*>|\[[^\]]*\]|[<>\[\]`*_#|\\]"
USER = r"(?U)(https?://)[^/\s@]+@"
# The sentences of the other tool.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\\[A-Za-z_][A-Za-z0-9_]*)*"
_MEMBER = _NAME + r"::(?:\$?[A-Za-z_][A-Za-z0-9_]*)(?:\(\))?"
_TYPE = r"\??" + _NAME + r"(?:\[\])*(?:[|&]\??" + _NAME + r"(?:\[\])*)*"
SENTENCES = (
    rf"(?:Method {_MEMBER}|Function {_NAME}\(\)) should return {_TYPE} but returns {_TYPE}\.",
    rf"Parameter #[1-9][0-9]? \$[A-Za-z_][A-Za-z0-9_]* of (?:method {_MEMBER}|function {_NAME}(?:\(\))?) expects {_TYPE}, {_TYPE} given\.",
    rf"Property {_MEMBER} \({_TYPE}\) does not accept {_TYPE}\.",
    rf"Access to an undefined property {_MEMBER}\.",
    rf"Call to an undefined (?:static )?method {_MEMBER}\.",
    rf"Function {_NAME} not found\.",
    rf"Class {_NAME} extends unknown class {_NAME}\.",
    rf"Class {_NAME} implements unknown interface {_NAME}\.",
    rf"Class {_NAME} uses unknown trait {_NAME}\.",
    rf"Attribute class {_NAME} does not exist\.",
)


def sanitised(message: str = "message") -> Column:
    """F-22. Null for a message that is missing or empty."""
    text = F.regexp_replace(F.substring(message, 1, MOST_READ), USER, "$1[redacted]@")
    for pattern, by in (
        (r"(?U)(?<![A-Za-z0-9_@.-])(?:[A-Za-z]:[\\/]|/)[^\s'\"`]+", "[path]"), (r"(?U)\b[A-Za-z0-9_=-]{24,}\b", "[redacted]"), (rf"(?iU)(?:\b|_){CREDENTIAL}[A-Za-z0-9_-]*", "[redacted]"),
    ):
        text = F.regexp_replace(text, pattern, by)
    # gaps[0], parts[0], gaps[1], ...: one gap more than parts
    cut = F.struct(F.split(text, QUOTED, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)).alias("parts"))
    touches = r"[\p{L}\p{N}_$'\"`]"

    def whole(c: Column) -> Column:
        gaps, parts, n = c["gaps"], c["parts"], F.size(c["parts"])
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        unsafe = F.exists(gaps, lambda g: g.rlike("['\"`]")) | F.exists(parts, lambda p: F.substring(p, 2, F.length(p) - 2).rlike("['\"`]")) | F.exists(
            at, lambda i: gaps[i].rlike(touches + r"\z") | gaps[i + 1].rlike(r"\A" + touches) | ((i > 0) & (gaps[i] == ""))
        )
        return F.when(unsafe, UNSAFE).otherwise(F.concat(F.array_join(F.transform(at, lambda i: F.concat(prose(gaps[i]), quoted(parts[i], gaps[i]))), ""), prose(gaps[n])))

    said = F.element_at(F.transform(F.array(cut), whole), 1)
    said = F.regexp_replace(F.regexp_replace(said, r"\p{C}", " "), r"(?U)\s+", " ")
    return F.when(F.length(message) > 0, F.substring(F.trim(said), 1, MOST_SAID))


def prose(text: Column) -> Column:
    """Markup outside quotes is withheld; the marks of what was replaced before stay."""
    found = F.regexp_extract_all(text, F.lit(MARKUP), F.lit(0))
    shown = F.transform(found, lambda m: F.when(m.isin("[path]", "[redacted]"), m).otherwise("[redacted]"))
    gaps = F.split(text, MARKUP, -1)
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), shown, lambda a, b: F.concat(a, b)), ""), F.element_at(gaps, -1))


def quoted(part: Column, before: Column) -> Column:
    inner = F.substring(part, 2, F.length(part) - 2)
    name = before.rlike(ANNOUNCED) & inner.rlike(IDENTIFIER) & (F.length(inner) <= 80)
    module = before.endswith("module ") & inner.rlike(MODULE) & (F.length(inner) <= 100) & ~F.array_contains(F.split(inner, "/"), "..")
    return F.when(name | module | inner.isin(*TYPES), part).otherwise("'[redacted]'")


def known_sentence(message: str = "message") -> Column:
    """F-23. The message if it is a known sentence without anything that could be a credential, else empty."""
    text = F.col(message)
    safe = (F.length(text) <= MOST_PHP) & (F.length(text) == F.octet_length(text)) & ~text.rlike(r"[\x00-\x1f\x7f]|[A-Za-z0-9_=-]{24,}") & ~text.rlike(rf"(?i)(?:\b|_){CREDENTIAL}") & ~text.rlike(USER)
    return F.when(safe & text.rlike(r"\A(?:" + "|".join(SENTENCES) + r")\z"), text).otherwise("")


# Events as messages: in each form the part in angle brackets is replaced by a word made from the event's id.
_FORMS = (
    ("Type ''string'' is not assignable to type ''number''.", "Type ''string'' is not assignable to type ''number''."),
    ("Property ''<w>'' does not exist on type ''<w>.T''.", "Property ''<w>'' does not exist on type ''<w>.T''."),
    ("Cannot find module ''@a/<w>'' or its types.", "Cannot find module ''@a/<w>'' or its types."),
    ("Cannot find module ''../<w>'' or its types.", "Cannot find module ''[redacted]'' or its types."),
    ("Found ''<w>'' here.", "Found ''[redacted]'' here."),
    ("It''s <w> unbalanced.", UNSAFE),
    ("Name ''<w>\"x'' nests.", UNSAFE),
    ("Name<w>''a'' touches.", UNSAFE),
    ("Name ''a'' ''b''<w> touches.", UNSAFE),
    ("See /home/<w>/x.ts for more.", "See [path] for more."),
    ("See https://<w>:pw@host.example/x now.", "See https:[path] now."),
    ("Key ghp_<w> was given.", "Key [redacted] was given."),
    ("Long aaaaaaaaaaaaaaaaaaaaaaaa<w> word.", "Long [redacted] word."),
    ("Generic List<T> and a[<w>] with * and _.", "Generic List[redacted] and a[redacted] with [redacted] and [redacted]."),
    ("Class \"<w>\" and  \t many\nspaces.", "Class \"<w>\" and many spaces."),
    ("Function <w> not found.", "Function <w> not found."),
)
_form = lambda k, word: " || ".join(f"'{x}'" for x in _FORMS[k][0].split("<w>")).replace(" || ", f" || {word} || ")
_said = lambda k, word: " || ".join(f"'{x}'" for x in _FORMS[k][1].split("<w>")).replace(" || ", f" || {word} || ")
_WORD = "'w' || cast(event_id as string)"
relation("ev_messages", f"select event_id, case event_id % {len(_FORMS)} {' '.join(f'when {k} then {_form(k, _WORD)}' for k in range(len(_FORMS)))} end as message from {{events}}", "events")
CHECK = (), f"""SELECT event_id, CASE event_id % {len(_FORMS)} {' '.join(f'WHEN {k} THEN {_said(k, _WORD)}' for k in range(len(_FORMS)))} END AS said,
  CASE WHEN event_id % {len(_FORMS)} = {len(_FORMS) - 1} THEN {_form(len(_FORMS) - 1, _WORD)} ELSE '' END AS sentence FROM events"""


def messages(rows: DataFrame) -> DataFrame:
    """event_id, said (F-22) and sentence (F-23) of rows (event_id, message)."""
    return rows.select("event_id", sanitised().alias("said"), known_sentence().alias("sentence"))
