"""Secret scan: strong patterns, and weak parts of a credential that count only beside their complement.

Only DataFrame functions are used. Every text is scanned inside its own row, so nothing is shuffled and one
long text or hot source cannot gather in a task. Offsets follow from the pieces between the matches; linking is
an interval join of a row's parts, sorted by start, with the parts whose start lies within ``reach``.

Defined cases: a null text counts as empty and gives no span; an empty table gives an empty result; repeated rows
are scanned one by one; result columns replace input columns of the same name, helper columns start with ``__``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
_OWNERS = "|".join(_either_case(w) for w in ("username", "user", "login", "client_id", "account"))
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""

#: (kind, pattern, role, weak, shortest match). The order of the kinds is the order of spans with one start.
KINDS = [
    ("assign", f"({_NAMES}){_SIGN}([A-Za-z0-9+/_.=-]+)", "secret", False, 14),
    ("access", "AKIA[A-Z0-9]{12,}", "identifier", False, 16),
    ("hex", "[0-9a-f]{32,}", "secret", False, 32),
    ("id", f"({_OWNERS}){_SIGN}[A-Za-z0-9._@-]{{3,}}", "identifier", True, 8),
    ("key", "[A-Za-z0-9+/_-]{20,}", "secret", True, 20),
    # Tried once a run of small letters: a match can begin only where none stands before it, and letters are not given back.
    ("url", r"""(?<![a-z])[a-z]++://[^\x00-\x20"'<>]+""", "endpoint", True, 5),
]
BASE = [k for k, _, _, weak, _ in KINDS if not weak]
REACH = 200
_BLOCK = 64
_PART = "struct<start:bigint,rank:int,end:bigint,hit:string>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _locate(df: DataFrame, text: str, patterns: Sequence[tuple[int, str]]) -> DataFrame:
    """Adds ``__p<rank>``: all matches of each pattern with their offsets in code points.

    Prefix sums go by blocks of 64 matches, so very many matches in one text cost little more than linear time.
    """
    cols = df.columns
    none = F.array().cast("array<string>")
    first = {}
    for rank, pattern in patterns:
        found = F.col(text).rlike(pattern)
        first[f"__h{rank}"] = F.when(found, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)
        first[f"__g{rank}"] = F.when(found, F.transform(F.split(F.col(text), pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
    df = df.select(*cols, *[v.alias(k) for k, v in first.items()])
    # One entry per match: the gap before it and its own length.
    df = df.select("*", *[F.zip_with(F.slice(f"__g{r}", 1, F.size(f"__h{r}")), f"__h{r}", lambda g, h: (g + F.length(h)).cast("bigint")).alias(f"__s{r}") for r, _ in patterns])

    def blocks(r: int) -> Column:
        count = F.ceil(F.size(f"__s{r}") / F.lit(_BLOCK)).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(F.slice(f"__s{r}", b * _BLOCK + 1, F.lit(_BLOCK))))).otherwise(F.array().cast("array<bigint>"))

    df = df.select("*", *[blocks(r).alias(f"__b{r}") for r, _ in patterns])

    def offsets(r: int) -> Column:
        return F.transform(F.col(f"__b{r}"), lambda _, i: _sum(F.slice(f"__b{r}", F.lit(1), i)))

    df = df.select("*", *[offsets(r).alias(f"__o{r}") for r, _ in patterns])

    def parts(r: int) -> Column:
        def one(hit: Column, i: Column) -> Column:
            block = F.floor(i / F.lit(_BLOCK)).cast("int")
            before = F.get(F.col(f"__o{r}"), block) + _sum(F.slice(f"__s{r}", block * _BLOCK + 1, i % _BLOCK))
            start = before + F.get(F.col(f"__g{r}"), i)
            return F.struct(start.alias("start"), F.lit(r).alias("rank"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

        return F.transform(F.col(f"__h{r}"), one).cast(f"array<{_PART}>")

    return df.select(*cols, *[parts(r).alias(f"__p{r}") for r, _ in patterns])


def scan_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, weak) by start and kind; offsets are code points, end exclusive.

    Strong kinds are always reported. A weak identifier needs a secret in its scope, a weak key an identifier, and an
    endpoint both; two parts share a scope when their starts are at most ``reach`` apart. A weak key that overlaps a
    strong span, or that lacks a digit, a small or a capital letter, is no candidate.
    """
    kept = [c for c in docs.columns if c != "spans"]
    df = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = _locate(df, "__text", [(r, p) for r, (_, p, _, _, _) in enumerate(KINDS)])
    rank = {k: i for i, (k, *_) in enumerate(KINDS)}
    assign = KINDS[0][1]
    strong = F.concat(
        F.filter(f"__p{rank['assign']}", lambda p: F.length(F.regexp_extract(p["hit"], assign, 2)) >= 8), F.col(f"__p{rank['access']}"), F.col(f"__p{rank['hex']}")
    )
    df = df.select(*kept, "__text", strong.alias("__strong"), *[f"__p{rank[k]}" for k in ("id", "key", "url")])
    mixed = lambda p: p["hit"].rlike("[0-9]") & p["hit"].rlike("[a-z]") & p["hit"].rlike("[A-Z]")
    clear = lambda p: ~F.exists("__strong", lambda s: (s["start"] < p["end"]) & (p["start"] < s["end"]))
    weak = F.concat(F.col(f"__p{rank['id']}"), F.filter(f"__p{rank['key']}", lambda p: mixed(p) & clear(p)), F.col(f"__p{rank['url']}"))
    df = df.select(*kept, "__text", F.array_sort(F.concat("__strong", weak)).alias("__parts"))
    # Matches of one kind do not overlap, so this many neighbours on either side hold every part within reach.
    near = sum(reach // least + 1 for *_, least in KINDS)
    of_role = {role: F.array(*[F.lit(i) for i, k in enumerate(KINDS) if k[2] == role]) for role in ("identifier", "secret")}
    is_weak = F.array(*[F.lit(i) for i, k in enumerate(KINDS) if k[3]])

    def linked(p: Column, i: Column) -> Column:
        around = F.slice("__parts", F.greatest(i + 1 - near, F.lit(1)), F.lit(2 * near + 1))
        has = lambda role: F.exists(around, lambda q: F.array_contains(of_role[role], q["rank"]) & (F.abs(q["start"] - p["start"]) <= reach))
        return (
            ~F.array_contains(is_weak, p["rank"])
            | ((p["rank"] == rank["id"]) & has("secret"))
            | ((p["rank"] == rank["key"]) & has("identifier"))
            | ((p["rank"] == rank["url"]) & has("identifier") & has("secret"))
        )

    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    out = F.transform(
        F.filter("__parts", linked),
        lambda p: F.struct(F.get(names, p["rank"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), F.array_contains(is_weak, p["rank"]).alias("weak")),
    )
    return df.select(*kept, F.when(F.size("__parts") > 0, out).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,weak:boolean>>")).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span, overlapping ones merged, replaced by ``mark``; other texts stay as they are."""
    # Columns go by position here, so that one of the input named spans is kept.
    names = [f"__c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index(text)]
    found = scan_secrets(docs.toDF(*names), body, reach)
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(body), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.concat(acc["out"], gap, F.when((s["start"] >= acc["at"]), F.lit(mark)).otherwise(F.lit("")))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(body), (acc["at"] + 1).cast("int"), F.length(F.col(body))))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", empty, step, rest)).otherwise(F.col(body))
    return found.select(*[(clean if n == body else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
