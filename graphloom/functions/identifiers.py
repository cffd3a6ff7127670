"""Column expressions over identifiers, paths, names and routes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of stub kinds, origin tiers in order, language aliases, test path markers.
STUB_KINDS = ("stdlib", "external_call", "builtin", "module")
ORIGINS = ("text_matched", "ast_inferred", "ast_resolved", "lsp_dispatch", "lsp_resolved")
LANGUAGES = {"ts": "typescript", "js": "javascript", "py": "python", "rb": "ruby", "rs": "rust", "kt": "kotlin", "yml": "yaml"}


def is_unresolved(target: Column) -> Column:
    return target.startswith("unresolved::") | target.contains("::unresolved::")


def stub_kind(target: Column) -> Column:
    """The stub kind of `<kind>::rest` or `<repo>::<kind>::rest`, else an empty text."""
    return F.regexp_extract(target, rf"^(?:[^:]+::)?({'|'.join(STUB_KINDS)})::", 1)


def stub_rest(target: Column) -> Column:
    """What follows the kind in the id of a stub; an empty text for other targets."""
    return F.regexp_extract(target, rf"^(?:[^:]+::)?(?:{'|'.join(STUB_KINDS)})::(?s:(.*))$", 1)


def stub_id(kind: str, *parts: Column, repo: Column | None = None) -> Column:
    """The id of a stub from its parts, behind the repository where one is given and not empty."""
    own = F.concat_ws("::", F.lit(kind), *parts)
    return own if repo is None else F.when(F.coalesce(repo, F.lit("")) == "", own).otherwise(F.concat_ws("::", repo, own))


def dropped_target(target: Column) -> Column:
    """Why a walk can't go on at a target; an empty text where it can."""
    return F.when(is_unresolved(target), "dynamic_dispatch").when(target.startswith("external::"), "external_boundary").when(stub_kind(target) != "", "stub").otherwise("")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", "")


def has_prefix(path: Column, prefix: str) -> Column:
    """Whole path segments only; an empty prefix matches everything."""
    p = prefix.replace("\\", "/").rstrip("/")
    return F.lit(True) if not p else (normal_path(path) == p) | normal_path(path).startswith(f"{p}/")


def package_of(path: Column, depth: int) -> Column:
    """The first `depth` segments, without a file name (a last segment with a dot)."""
    parts = F.split(path, "/")
    dirs = F.when(F.element_at(parts, -1).contains("."), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.concat_ws("/", F.slice(dirs, 1, depth))


def directory_of(path: Column) -> Column:
    found = F.regexp_extract(path, "^(.*)/", 1)
    return F.when(found == "", "(root)").otherwise(found)


def tokens(name: Column) -> Column:
    """Lower-case parts of an identifier, camel case split, single letters dropped."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda t: F.length(t) >= 2)


def origin_rank(origin: Column) -> Column:
    """5 for the surest tier down to 1; 0 where unknown."""
    out = F.lit(0)
    for i, tier in enumerate(ORIGINS, 1):
        out = F.when(origin == tier, i).otherwise(out)
    return out


def provenance_weight(origin: Column) -> Column:
    """Weight for centrality: static resolution most, then language servers, then guesses (numbers are ours)."""
    return F.when(origin == "ast_resolved", 1.0).when(origin == "lsp_resolved", 0.9).when(origin == "lsp_dispatch", 0.8).when(origin == "ast_inferred", 0.6).when(origin == "text_matched", 0.25).otherwise(0.6)


def route(url: Column) -> Column:
    """Scheme, host, query and fragment go; numbers and placeholders become positional {pN}."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", ""), r"[?#].*$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    hole = lambda s: s.rlike(r"^(:.+|<.+>|\{.+\}|[0-9]+)$")
    named = F.transform(segments, lambda s, i: F.when(hole(s), F.concat(F.lit("{p"), F.size(F.filter(F.slice(segments, 1, i + 1), hole)).cast("string"), F.lit("}"))).otherwise(s))
    return F.concat(F.lit("/"), F.concat_ws("/", named))


def filename_score(path: Column, query: str) -> Column:
    """100 the name, 70 its start, 50 in it, 30 in the path, 10 letters in order, else 0."""
    import re

    q = query.lower()
    name, whole = F.lower(F.substring_index(path, "/", -1)), F.lower(path)
    letters = ".*".join(map(re.escape, q))
    return F.when(name == q, 100).when(name.startswith(q), 70).when(name.contains(q), 50).when(whole.contains(q), 30).when(whole.rlike(letters), 10).otherwise(0)


def half_life(days: Column, half: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) / half * days)


def half_up(value: Column, digits: int = 3) -> Column:
    """Rounds halves up, as floor(v * 10^n + 0.5) does."""
    return F.floor(value * 10**digits + 0.5) / float(10**digits)


def glob_regex(glob: str) -> str:
    """The pattern of a path glob: `**` crosses folders, `*` and `?` don't; `**/` may also be nothing."""
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at]))
            at += 1
    return f"^{out}$"


# Marks of a test's path.
TEST_MARKS = ("_test.go", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "__tests__/", "test_")


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | path.contains(mark)
    return F.coalesce(out, F.lit(False))


def normal_language(name: Column) -> Column:
    """Lower case without blanks around, short names written out."""
    low = F.lower(F.trim(name))
    out = low
    for short, full in LANGUAGES.items():
        out = F.when(low == short, full).otherwise(out)
    return out


def moment(text: Column) -> Column:
    """A timestamp from seconds, whole or not, or from an ISO text with a zone; else null."""
    seconds = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(F.floor(text.try_cast("double")).cast("long")))
    return F.coalesce(seconds, F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T.*(Z|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(text)))


def token_estimate(nodes: Column) -> Column:
    """Tokens of an answer with so many nodes: 28 bytes each, three and a half bytes to a token, rounded down."""
    return F.floor(nodes * 28 * 10 / 35)


def owner_of(id_: Column) -> Column:
    """The symbol that an id of a part of it (`symbol#part`) belongs to; null for a symbol itself."""
    return F.when(id_.contains("#"), F.substring_index(id_, "#", 1))
