"""Secret scans by linking the parts of credentials (operator 7, native).

Base spans are strong by themselves: assignments (``assign``), access identifiers (``access``) and long
hexadecimal runs (``hex``). Weak candidates are parts that mean nothing alone: named identifiers (``id``), mixed
random-looking runs (``key``) and endpoints (``endpoint``). A weak candidate is reported only when a part that
completes it lies in its scope, ``scope`` code points on either side and within the same paragraph (no blank line
between): an identifier or an endpoint needs a secret (assign, hex or key), a key needs an identifier or an
endpoint (access, id or endpoint). Weak candidates that overlap a base span are that span, not a second one.

All spans are code points, end exclusive. The link is an interval join within one text: the parts are sorted by
start and swept once in each direction, each part seeing the nearest end before and the nearest start behind
of the parts that complete it, so that no pairs are made and no row leaves its task. Places and sweeps are running
sums and maxima, taken in blocks, so that a text costs time in proportion to its length and matches. Null and empty
texts have no spans; repeated rows are scanned one by one; other columns are carried through as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. Group 1 of the assignment is its value.
ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: 20 and 24 characters at least: a run that is too short holds no longer one, so the bound can be in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak parts: a named identifier, a run of 32 or more that mixes digits, lower and upper case, an endpoint.
NAMED = "(?i:(?:access|client|account|tenant)[_-]?(?:key[_-]?)?id)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
RUN = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = "(?i:https?://[^\\x20\\x09-\\x0D\"'<>]+|(?:endpoint|host)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9.:/-]{4,})"
#: Order of the kinds in the lists of spans.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: A blank line, which ends the scope; a kind of its own in the sweep only.
WALL = len(KINDS)
SPAN = "array<struct<s:int,k:int,e:int,v:int>>"
#: Items of a block of a running fold, and characters of a part of a text.
BLOCK, PART = 64, 1024


def _running(name: str, value: Callable[[Column], Column], fold: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item of the array column ``name`` the fold of the values up to and with it.

    Blocks are folded by themselves, then raised by the fold of all before them: appending to a list copies it,
    so that one list of all would cost the square of the items. ``name`` has to be a column of the table, not an
    expression, which each block would evaluate anew."""
    size = F.size(name)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda i: F.slice(name, i * BLOCK + 1, BLOCK))

    def within(block: Column) -> Column:
        start = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = fold(acc["at"], value(x))
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(block, start, step)

    def behind(acc: Column, block: Column) -> Column:
        raised = F.struct(acc["at"].alias("by"), block["out"].alias("own"))
        return F.struct(fold(acc["at"], block["at"]).alias("at"), F.concat(acc["out"], F.array(raised)).alias("out"))

    none = F.struct(zero.alias("by"), F.array(zero).alias("own"))
    start = F.struct(zero.alias("at"), F.filter(F.array(none), lambda _: F.lit(False)).alias("out"))
    raised = F.aggregate(F.transform(blocks, within), start, behind, lambda acc: acc["out"])
    folded = F.flatten(F.transform(raised, lambda r: F.transform(r["own"], lambda x: fold(r["by"], x))))
    return F.when(size > 0, folded).otherwise(F.filter(F.array(zero), lambda _: F.lit(False)))


def _steps(text: str, pattern: str, likely: Column, value: bool = False) -> Column:
    """All leftmost non-overlapping matches as (length of the gap before, of the match, of its value).

    The search is tied to the end of the last match, so that a text costs one pass."""
    shell = f"\\G([\\s\\S]*?)({pattern})"
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(shell), F.lit(group)), F.char_length)
    steps = F.arrays_zip(lengths(1).alias("g"), lengths(2).alias("w"), lengths(3 if value else 2).alias("v"))
    return F.when(likely, steps).otherwise(F.array().cast("array<struct<g:int,w:int,v:int>>"))


def _places(steps: str, kind: int) -> Column:
    """The matches as (start, kind, end, length of the value) in code points."""
    ends = _running(steps, lambda x: x["g"] + x["w"], lambda a, b: a + b, F.lit(0))

    def span(x: Column, end: Column) -> Column:
        return F.struct((end - x["w"]).alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["v"].alias("v"))

    return F.zip_with(steps, ends, span).cast(SPAN)


def _free(parts: str, turned: str) -> Column:
    """Of base and weak spans, sorted, the weak ones that overlap no base span; ``turned`` holds them from the last."""
    far, base = F.lit(-(1 << 30)), lambda x: x["k"] < 3
    # the last end of base spans that start before (or with) a span, and the first start of those behind it
    ends = _running(parts, lambda x: F.when(base(x), x["e"]).otherwise(far), F.greatest, far)
    starts = F.reverse(_running(turned, lambda x: F.when(base(x), -x["s"]).otherwise(far), F.greatest, far))
    around = F.zip_with(ends, starts, lambda end, start: F.struct(end.alias("end"), (-start).alias("start")))
    apart = lambda x, near: F.when((x["k"] >= 3) & (near["end"] <= x["s"]) & (near["start"] >= x["e"]), x)
    return F.filter(F.zip_with(parts, around, apart), lambda x: x.isNotNull())


def _linked(parts: str, turned: str, scope: int) -> Column:
    """The weak parts, in the order of the array, that a completing part ends before or starts behind within the
    scope, with no wall between; ``turned`` holds the parts from the last."""
    far = F.lit(-(1 << 30))
    secret = lambda p: p["k"].isin(0, 2, 4)
    fields = {"secret": secret, "name": lambda p: p["k"].isin(1, 3, 5), "wall": lambda p: p["k"] == WALL}

    def nearest(name: str, edge: Callable[[Column], Column]) -> Column:
        return _running(
            name,
            lambda p: F.struct(*[F.when(which(p), edge(p)).otherwise(far).alias(n) for n, which in fields.items()]),
            lambda a, b: F.struct(*[F.greatest(a[n], b[n]).alias(n) for n in fields]),
            F.struct(*[far.alias(n) for n in fields]),
        )

    def near(p: Column, seen: Column, at: Column) -> Column:
        other = F.when(secret(p), seen["name"]).otherwise(seen["secret"])
        return (other > seen["wall"]) & (at - other <= scope)

    before, behind = nearest(parts, lambda p: p["e"]), F.reverse(nearest(turned, lambda p: -p["s"]))
    around = F.zip_with(before, behind, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    hit = lambda p, seen: F.when(p["k"].isin(3, 4, 5) & (near(p, seen["x"], p["s"]) | near(p, seen["y"], -p["e"])), p)
    return F.filter(F.zip_with(parts, around, hit), lambda x: x.isNotNull())


def scan(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """docs (of two columns, one the text) with base_spans and linked_spans: arrays of (s, k, e, v), k the place of the kind in KINDS, sorted."""
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", F.lower("_t"))
    has = lambda *parts: functools.reduce(lambda a, b: a | b, [F.col("_low").contains(x) for x in parts])
    found = {
        "_assign": (ASSIGN, has("password", "passwd", "secret", "token", "api_key", "apikey")),
        "_access": (ACCESS, F.col("_t").contains("AKIA")),
        "_hex": (HEX, F.col("_t").rlike("[0-9a-f]{24}")),
        "_id": (NAMED, has("access", "client", "account", "tenant")),
        "_run": (RUN, F.col("_t").rlike("[A-Za-z0-9+/_-]{32}")),
        "_end": (ENDPOINT, has("://") | (has("endpoint", "host") & F.col("_low").rlike("(?:endpoint|host)[\"']?\\x20*[:=]"))),
    }
    d = d.withColumns({name: _steps("_t", pattern, likely, name == "_assign") for name, (pattern, likely) in found.items()})
    d = d.withColumns({name: _places(name, kind) for kind, name in enumerate(found)})
    d = d.withColumn("base_spans", F.sort_array(F.concat(F.filter("_assign", lambda x: x["v"] >= 6), "_access", "_hex")))
    none = F.array().cast(SPAN)
    weak = F.concat("_id", "_run", "_end")
    d = d.withColumn("_both", F.when(F.size(weak) > 0, F.sort_array(F.concat("base_spans", weak))).otherwise(none))
    d = d.withColumn("_turned", F.reverse("_both")).withColumn("_weak", _free("_both", "_turned"))
    some = F.size("_weak") > 0
    d = d.withColumn("_wall", _steps("_t", "\\n[\\x20\\x09\\x0D]*\\n", some)).withColumn("_wall", _places("_wall", WALL))
    d = d.withColumn("_all", F.when(some, F.sort_array(F.concat("base_spans", "_weak", "_wall"))).otherwise(none))
    d = d.withColumn("_back", F.reverse("_all")).withColumn("linked_spans", _linked("_all", "_back", scope))
    return d.drop("_t", "_low", *found, "_both", "_turned", "_weak", "_wall", "_all", "_back")


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of docs."""
    d = scan(docs.select(F.col(key), F.col(text).alias("_text")), "_text", scope)
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")
    return d.select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base_spans", "linked_spans"))).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", scope: int = 200) -> DataFrame:
    """docs with every span replaced by the name of its kind in brackets; overlapping spans by the first's."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("body"))
    d = scan(rows, "body", scope).withColumn("spans", F.sort_array(F.concat("base_spans", "linked_spans")))
    some = F.size("spans") > 0
    d = d.withColumns({
        # parts of the text, so that a stretch of it is taken without counting characters from its begin
        "parts": F.when(some, F.regexp_extract_all("body", F.lit(f"[\\s\\S]{{1,{PART}}}"), F.lit(0))),
        "reach": F.concat(F.array(F.lit(0)), _running("spans", lambda x: x["e"], F.greatest, F.lit(0))),
    })
    names = F.array(*map(F.lit, KINDS))

    def stretch(a: Column, b: Column) -> Column:
        first = F.floor(a / PART).cast("int")
        some = F.array_join(F.slice("parts", first + 1, F.floor((b - 1) / PART).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(some, a % PART + 1, b - a)).otherwise("")

    def shown(x: Column, before: Column) -> Column:
        masked = F.concat(stretch(before, x["s"]), F.lit("["), F.get(names, x["k"]), F.lit("]"))
        return F.when(x["s"] >= before, masked).otherwise("")

    last = F.element_at("reach", -1)
    pieces = F.zip_with("spans", F.slice("reach", 1, F.size("spans")), shown)
    masked = F.concat(F.array_join(pieces, ""), stretch(last, F.char_length("body")))
    return d.select(F.col("row").withField(text, F.when(some, masked).otherwise(F.col("body"))).alias("row")).select("row.*")
