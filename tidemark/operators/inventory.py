"""Inventory, scope and selection of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import in_scope, is_test, language, normalized_paths, safe, safe_link, suffix
from ..plans.relation import RELATIONS, relation
from ..schema import EXCLUDED_DIRECTORIES, MAX_FILE_BYTES, MAX_FILES, MAX_TREE_BYTES
from .icons import icon

relation("in_scope", "select relative_path, in_scope from {ev_files}", "ev_files")
relation("test_paths", "select relative_path, is_test from {ev_files}", "ev_files")
relation("languages", "select language, count(*) as files, count_if(not is_test) as production_files from {ev_files} where language <> '' group by language", "ev_files")
# Suffixes of the function-complexity stage, and languages that a call analyzer reads or that need none.
MEASURED_SUFFIXES = (
    "py", "java", "c", "h", "cpp", "hpp", "cc", "cxx", "cs", "go", "rs", "rb", "swift", "m", "mm", "scala", "lua", "php", "kt", "kts", "ttcn", "ttcnpp", "gd", "zig",
)
CALL_LANGUAGES = ("python", "javascript", "typescript", "java", "shell", "php", "php-blade", "", "unknown", "text")
_quoted = lambda values: ", ".join(f"'{v}'" for v in values)

# P-3, P-7: production files of measured suffixes, PHP apart
relation("language_slice", f"""
select relative_path, language, size_bytes from {{ev_files}} where in_scope and language <> '' and not is_test and language not in ('php', 'php-blade') and {suffix("relative_path")} in ({_quoted(MEASURED_SUFFIXES)})
""", "ev_files")

# What acquisition found: files of a snapshot, with sizes that reach beyond the budget of one file
relation("ev_scope", f"""
select cast(floor(doc_id / 500) as bigint) as snapshot, relative_path, language, is_test, size_bytes * 997 as size_bytes,
  case when doc_id % 31 = 0 then 'binary-asset' when size_bytes * 997 > {MAX_FILE_BYTES} then 'possible-source' else 'text' end as classification
from {{ev_files}} where in_scope
""", "ev_files")

# A-14, S-14 with P-2: counters by classification; what may be source and isn't inventoried limits the stage
relation("inventory", """
select snapshot, count_if(classification = 'text') as files, count_if(classification = 'text' and language <> '' and not is_test) as production_files,
  count(distinct case when classification = 'text' and language <> '' then language end) as languages, coalesce(sum(case when classification = 'text' then size_bytes end), 0) as bytes,
  count_if(classification = 'binary-asset') as binary_asset_files, count_if(classification = 'possible-source') as omitted_possible_source_files, count_if(classification <> 'binary-asset') as eligible_files,
  case when count_if(classification = 'possible-source') > 0 then 'limited' else 'ok' end as status
from {ev_scope} group by snapshot
""", "ev_scope")
relation("excluded_directories", f"""
select d as directory, count(*) as files from (select regexp_extract(relative_path, r'(?:^|/)({"|".join(x.replace(".", r"[.]") for x in EXCLUDED_DIRECTORIES)})/', 1) as d from {{ev_files}} where not in_scope) t group by d
""", "ev_files")

# P-6
relation("scope_manifest", """
select snapshot, relative_path, size_bytes, classification, case classification when 'binary-asset' then 'Recognized binary asset' else 'Content exceeds per-file text acquisition budget' end as reason
from {ev_scope} where classification <> 'text'
""", "ev_scope")

# F-11, F-12: contents of every form, as hexadecimal text; the query is classified() over their bytes
relation("ev_contents", """
select relative_path, case doc_id % 9 when 0 then '89504E470D0A1A0A00' when 1 then hex(content) when 2 then '504B030400' when 3 then '4100' || hex(content) when 4 then 'FFFE41'
  when 5 then '000000186674797069736F6D000000000000000000000000' when 6 then '524946460000000057454250' when 7 then '255044462D312E3700' else '7FFFFF' end as content_hex
from {ev_files}
""", "ev_files")
relation("classify_content", f"""
select relative_path, case when try(decode(raw)) is not null and instr(h, '|00') = 0 then 'text'
  when {language("relative_path")} <> '' or {suffix("relative_path")} in ('md', 'txt', 'ini', 'cfg', 'env', 'json', 'toml', 'yaml', 'yml', 'xml', 'html', 'css', 'sql') then 'possible-source'
  when startswith(content_hex, '89504E470D0A1A0A') or startswith(content_hex, '504B0304') or startswith(content_hex, '255044462D312E') or startswith(content_hex, '52494646') or substring(content_hex, 9, 16) = '6674797069736F6D' then 'binary-asset'
  else 'possible-source' end as classification
from (select relative_path, content_hex, unhex(content_hex) as raw, regexp_replace(content_hex, '(..)', '|\\1', 'g') as h from {{ev_contents}}) c
""", "ev_contents")  # the check statement

# P-4, P-5, F-15: literal prefixes, then the changed set
relation("selected_paths", """
select f.relative_path, f.size_bytes from {ev_files} f
where exists (select 1 from (select 'tests/src1' as prefix union all select 'src2' union all select 'src3/doc_3.py') p where f.relative_path = p.prefix or startswith(f.relative_path, p.prefix || '/'))
  and f.doc_id % 2 = 0
""", "ev_files")
relation("path_selection", """
select 'paths-and-changed-paths' as mode, t.total, s.selected, t.total - s.selected as omitted
from (select count(*) as total from {ev_files}) t cross join (select count(*) as selected from {selected_paths}) s
""", "ev_files", "selected_paths")

relation("safe_paths", f"""
select path, {safe("path")} as is_safe from (
  select relative_path as path from {{ev_files}} union all select '../' || relative_path from {{ev_files}} where doc_id % 3 = 0 union all select '/' || relative_path from {{ev_files}} where doc_id % 5 = 0
  union all select source_dir || '/.git/' || cast(doc_id as string) from (select doc_id, regexp_extract(relative_path, r'^([^/]*)/', 1) as source_dir from {{ev_files}} where doc_id % 7 = 0) g) t
""", "ev_files")

# F-14: links must stay inside the tree
relation("ev_links", """
select doc_id, relative_path as path, case doc_id % 6 when 0 then '../x' when 1 then '../../x' when 2 then './a/../../y' when 3 then '/etc/x' when 4 then '' else 'a//b/.' end as target from {ev_files}
""", "ev_files")
relation("safe_links", f"select doc_id, path, target, {safe_link('path', 'target')} as is_safe from {{ev_links}}", "ev_links", check="""
select doc_id, path, target, case target when '../x' then path like '%/%' when '../../x' then path like '%/%/%' when './a/../../y' then path like '%/%' when 'a//b/.' then true else false end as is_safe from {ev_links}
""")

# W-3, first variant: content is read while the bytes read before stay under the budget
relation("running_budget", f"""
select snapshot, relative_path, size_bytes, case when before >= 500000 then 0 else least(size_bytes, {MAX_FILE_BYTES + 1}, 500000 - before) end as bytes_read
from (select cast(floor(doc_id / 500) as bigint) as snapshot, relative_path, size_bytes,
    coalesce(sum(size_bytes) over (partition by cast(floor(doc_id / 500) as bigint) order by relative_path, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from {{ev_files}} where in_scope) t
""", "ev_files")

# W-3, second variant, and W-4: the check folds row by row; the queries are greedy_budget() and batch_packing()
_ROWS = "r as (select cast(floor(doc_id / 500) as bigint) as snapshot, relative_path, size_bytes, row_number() over (partition by floor(doc_id / 500) order by relative_path, size_bytes) as k from {ev_files})"
relation("greedy_budget", f"""
with recursive {_ROWS},
f as (select snapshot, relative_path, size_bytes, k, size_bytes <= 200000 as selected, case when size_bytes <= 200000 then size_bytes else 0 end as used from r where k = 1
  union all select r.snapshot, r.relative_path, r.size_bytes, r.k, f.used + r.size_bytes <= 200000, case when f.used + r.size_bytes <= 200000 then f.used + r.size_bytes else f.used end from f join r on r.snapshot = f.snapshot and r.k = f.k + 1)
select snapshot, relative_path, size_bytes, selected from f
""", "ev_files")
relation("batch_packing", f"""
with recursive {_ROWS},
f as (select snapshot, relative_path, size_bytes, k, cast(0 as bigint) as batch, 1 as held, size_bytes as used from r where k = 1
  union all select r.snapshot, r.relative_path, r.size_bytes, r.k, case when f.held >= 32 or f.used + r.size_bytes > 524288 then f.batch + 1 else f.batch end,
    case when f.held >= 32 or f.used + r.size_bytes > 524288 then 1 else f.held + 1 end, case when f.held >= 32 or f.used + r.size_bytes > 524288 then r.size_bytes else f.used + r.size_bytes end
  from f join r on r.snapshot = f.snapshot and r.k = f.k + 1)
select snapshot, relative_path, size_bytes, batch from f
""", "ev_files")

# J-2, S-10: paths of two trees by content hash
relation("blob_hash", "select relative_path, doc_id, sha1('blob ' || cast(octet_length(content) as string) || char(0) || content) as oid from {ev_files}", "ev_files")
for _side, _rule in (("base", "doc_id % 11 <> 0"), ("head", "doc_id % 13 <> 0")):
    _oid = "oid" if _side == "base" else "case when doc_id % 9 = 0 then 'x' || oid else oid end"
    relation(f"{_side}_tree", f"select relative_path as path, {_oid} as oid from {{blob_hash}} where {_rule}", "blob_hash")
relation("changed_paths", """
select coalesce(b.path, h.path) as path, case when b.path is null then 'A' when h.path is null then 'D' else 'M' end as status
from {base_tree} b full outer join {head_tree} h on b.path = h.path where b.oid is distinct from h.oid
""", "base_tree", "head_tree")
relation("tree_diff", "select count(*) > 0 as dirty, count_if(status = 'A') as added, count_if(status = 'D') as deleted, count_if(status = 'M') as modified from {changed_paths}", "changed_paths")

# U-5, U-6
relation("inventory_equal", """
select (select count(*) from (select path from {base_tree} except select path from {head_tree}) x) as only_base, (select count(*) from (select path from {head_tree} except select path from {base_tree}) y) as only_head
""", "base_tree", "head_tree")

# J-7, J-8, P-11
relation("foreign_locations", "select f.snapshot_id, f.path, count(*) as findings from {ev_head} f left anti join {ev_changed_lines} i on i.path = f.path where f.path <> '' group by f.snapshot_id, f.path", "ev_head", "ev_changed_lines",
         check="select f.snapshot_id, f.path, count(*) as findings from {ev_head} f where f.path <> '' and f.path not in (select path from {ev_changed_lines}) group by f.snapshot_id, f.path")
relation("omitted_paths", "select m.relative_path, m.reason from {scope_manifest} m left anti join {language_slice} s on m.relative_path = s.relative_path", "scope_manifest", "language_slice",
         check="select m.relative_path, m.reason from {scope_manifest} m anti join {language_slice} s on m.relative_path = s.relative_path")
relation("unsupported_languages", f"select language from {{languages}} where language not in ({_quoted(CALL_LANGUAGES)})", "languages")

# A-15
relation("hygiene_facts", """
select bool_or(regexp_like(lower(name), r'^(license|licence|copying)([.]|$)') and size_bytes > 0) as license_file, bool_or(regexp_like(lower(name), r'^readme([.]|$)') and length(regexp_replace(regexp_replace(content, r'^[ \\t\\r\\n]+', ''), r'[ \\t\\r\\n]+$', '')) > 100) as nontrivial_readme,
  bool_or(is_test and size_bytes > 0) as test_files, bool_or(name = '.gitignore') as gitignore_file, bool_or(name = '.gitlab-ci.yml' or regexp_like(path, r'^[.]github/workflows/.*[.]ya?ml$')) as ci_configuration,
  bool_or(name in ('uv.lock', 'poetry.lock', 'Pipfile.lock', 'package-lock.json', 'npm-shrinkwrap.json', 'pnpm-lock.yaml', 'yarn.lock', 'Cargo.lock', 'go.sum', 'Gemfile.lock', 'composer.lock')) as dependency_lockfile
from (select case when instr(path, '/') = 0 then path else '' end as name, path, is_test, size_bytes, content from (
  select case when doc_id = 10 then 'LICENSE.md' when doc_id = 20 then 'README.md' when doc_id = 30 then '.gitignore' when doc_id = 40 then '.github/workflows/ci.yml' else relative_path end as path, is_test, size_bytes, case when doc_id = 20 then '  ' || substring(content, 1, 95) || repeat(' ', 200) else content end as content from {ev_files}) n) t
""", "ev_files")


def inventoried(files: DataFrame) -> DataFrame:
    """files (relative_path, size_bytes, content) with language, is_test and in_scope."""
    return files.selectExpr("*", f"{language('relative_path')} as language", f"{is_test('relative_path')} as is_test", f"{in_scope('relative_path')} as in_scope")


# The first bytes of binary assets, and the brands of RIFF and ISO containers.
SIGNATURES = (
    b"PK\x03\x04", b"PK\x05\x06", b"\x1f\x8b\x08", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"\x7fELF", b"\x00asm\x01\x00\x00\x00", b"wOFF", b"wOF2",
    b"\x00\x01\x00\x00", b"OTTO", b"BZh", b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"%PDF-1.", b"%PDF-2.",
)
RIFF_FORMS = (b"WEBP", b"WAVE", b"AVI ")
ISO_BRANDS = (b"isom", b"iso2", b"mp41", b"mp42", b"M4V ", b"qt  ", b"avif", b"avis")


def classified(content: str = "content") -> Column:
    """F-11 to F-13 on bytes: text, binary-asset or possible-source, from a BINARY column and relative_path."""
    head, raw = F.hex(F.substring(content, 1, 16)), F.col(content)
    of = lambda b: b.hex().upper()
    # a hexadecimal 00 counts only at an even offset
    text = F.expr(f"is_valid_utf8({content})") & ~F.hex(raw).rlike("^(..)*?00")
    source = F.expr(f"{language('relative_path')} <> '' or {suffix('relative_path')} in ('md', 'txt', 'ini', 'cfg', 'env', 'json', 'toml', 'yaml', 'yml', 'xml', 'html', 'css', 'sql')")
    asset = F.lit(False)
    for magic in SIGNATURES:
        asset = asset | head.startswith(of(magic))
    riff = head.startswith(of(b"RIFF")) & F.substring(head, 17, 8).isin(*map(of, RIFF_FORMS))
    size = F.conv(F.substring(head, 1, 8), 16, 10).cast("long")
    iso = (F.substring(head, 9, 8) == of(b"ftyp")) & size.between(16, F.octet_length(raw)) & F.substring(head, 17, 8).isin(*map(of, ISO_BRANDS))
    return F.when(text, "text").when(source, "possible-source").when(asset | riff | iso | icon(content), "binary-asset").otherwise("possible-source")


def blob_oid(content: str = "content") -> Column:
    """F-28: the object id of a blob, over its header and bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col(content)))


def selection(files: DataFrame, prefixes: list[str], changed: DataFrame | None = None) -> DataFrame:
    """P-4: files under a literal prefix (or any, if there are none), and in the changed set if one is given."""
    keep = F.lit(not prefixes)
    for p in normalized_paths(prefixes):
        keep = keep | (F.col("relative_path") == p) | F.col("relative_path").startswith(p + "/")
    out = files.where(keep)
    return out if changed is None else out.join(changed.selectExpr("path as relative_path").distinct(), "relative_path", "left_semi")


def tree_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    return RELATIONS["changed_paths"].over(base_tree=base, head_tree=head)


def capped(group):
    """T-7: a snapshot of more than MAX_FILES selected files is refused, so that an order-dependent fold stays bounded."""
    if len(group) > MAX_FILES:
        raise ValueError(f"a snapshot has more than {MAX_FILES} selected files")
    return group


def greedy_budget(files: DataFrame, limit: int = MAX_TREE_BYTES) -> DataFrame:
    """W-3, second variant: in path order an entry that would overflow is skipped and later smaller ones still fit.

    The fold is order-dependent, so it is one group for each snapshot; more than MAX_FILES files are an error."""

    def fold(group):
        group = capped(group)
        group = group.sort_values(["relative_path", "size_bytes"], kind="stable").reset_index(drop=True)
        used, taken = 0, []
        for size in group["size_bytes"]:
            fits = used + size <= limit
            used += int(size) if fits else 0
            taken.append(bool(fits))
        return group.assign(selected=taken)

    rows = files.select("snapshot", "relative_path", "size_bytes")
    return rows.groupBy("snapshot").applyInPandas(fold, "snapshot long, relative_path string, size_bytes long, selected boolean")


def batch_packing(files: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """W-4: consecutive files of a snapshot in batches of bounded number and bytes; a larger file stands alone."""

    def fold(group):
        group = capped(group)
        group = group.sort_values(["relative_path", "size_bytes"], kind="stable").reset_index(drop=True)
        batch, held, size, out = 0, 0, 0, []
        for s in group["size_bytes"]:
            if held and (held >= most or size + s > most_bytes):
                batch, held, size = batch + 1, 0, 0
            held, size = held + 1, size + int(s)
            out.append(batch)
        return group.assign(batch=out)

    rows = files.select("snapshot", "relative_path", "size_bytes")
    return rows.groupBy("snapshot").applyInPandas(fold, "snapshot long, relative_path string, size_bytes long, batch long")
