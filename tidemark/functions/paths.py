"""Path and content predicates as SQL expressions."""

from __future__ import annotations

from ..schema import EXCLUDED_DIRECTORIES, LANGUAGES


def base_name(path: str) -> str:
    return f"regexp_extract({path}, r'([^/]*)$', 1)"


def suffix(path: str) -> str:
    """Lower-case suffix without its dot; '' for none and for a leading dot only."""
    return f"lower(regexp_extract({path}, r'[^/]\\.([^./]+)$', 1))"


def stem(path: str) -> str:
    """The file name without its last suffix."""
    name = base_name(path)
    return f"(case when regexp_like({name}, r'^.+\\.[^.]+$') then regexp_extract({name}, r'^(.+)\\.[^.]+$', 1) else {name} end)"


def in_scope(path: str) -> str:
    """No parent directory is an excluded one; a file of that name is in scope."""
    names = "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRECTORIES)
    return f"(not regexp_like({path}, r'(^|/)({names})/'))"


def language(path: str) -> str:
    """The language of a suffix, looked up in one text so that the suffix is computed once."""
    table = "|".join(f"{k}={v}" for k, v in LANGUAGES.items())
    return f"(case when endswith(lower({path}), '.blade.php') then 'php-blade' else split_part(split_part('|{table}|', '|' || {suffix(path)} || '=', 2), '|', 1) end)"


def is_test(path: str) -> str:
    """A part named like a test folder, or a file name of a test's form; the suffixes Test and Tests are exact."""
    s = stem(path)
    return f"""(regexp_like(lower({path}), r'(^|/)(test|tests|__tests__|spec|specs)(/|$)') or ({suffix(path)} = 'php' and lower({s}) = 'pest')
        or regexp_like(lower({s}), r'^test$|^test_|(_test|\\.test|\\.spec|_spec)$') or regexp_like({s}, r'(Test|Tests)$'))"""


def safe(path: str) -> str:
    """Relative, not empty, and without .. or .git parts."""
    return f"({path} <> '' and not startswith({path}, '/') and not regexp_like({path}, r'(^|/)(\\.\\.|\\.git)(/|$)') and not regexp_like({path}, r'^[./]*$'))"


MOST_SELECTED, MOST_PATH = 256, 4096


def normalized_paths(paths: list[str]) -> list[str]:
    """F-15: the sorted, distinct paths of a selection; each is literal, relative and whole, or the selection is refused."""
    if len(paths) > MOST_SELECTED:
        raise ValueError(f"a selection has at most {MOST_SELECTED} paths")
    out = set()
    for path in paths:
        plain = isinstance(path, str) and 0 < len(path) <= MOST_PATH and path[0] not in "/-" and not any(ord(c) < 32 or c in "\x7f\\:*?[]" for c in path)
        if not plain or {"", ".", "..", ".git"} & set(path.rstrip("/").split("/")):
            raise ValueError("a selection has literal paths below the repository only")
        out.add(path.rstrip("/"))
    return sorted(out)


def safe_link(path: str, target: str) -> str:
    """A link whose target, followed from the link's folder, never leaves the tree: its depth is folded part by part."""
    depth = f"(length({path}) - length(replace({path}, '/', '')))"
    step = "case when d < 0 or part in ('', '.') then d when part = '..' then d - 1 else d + 1 end"
    return f"({target} <> '' and not startswith({target}, '/') and aggregate(split({target}, '/'), {depth}, (d, part) -> {step}) >= 0)"
