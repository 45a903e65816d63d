"""Secret scans: fixed patterns, and a battery of randomness tests on key-like strings; DataFrame operations only.

*Patterns.* Three kinds, leftmost and without overlap within a kind: assignments of a password, secret, token or key; access
key names; long hexadecimal strings.

*Battery.* A candidate is a run of at least ``MIN_LENGTH`` characters of the URL-safe or standard base64 alphabet with a
letter and a digit, apart from the spans above. Its encoding is the first alphabet that holds all of its characters. A run that fits none
(one of ``+ /`` and one of ``- _``) is cut at all four, and each letter and digit piece of at least ``MIN_LENGTH`` is a candidate; so are the pieces
between ``+ /`` alone and between ``- _`` alone that hold no such piece, and these may overlap. Three
tests ask whether it is a random string of that encoding: chi-squared of the symbol counts against equal counts
(Wilson-Hilferty), the Wald-Wolfowitz runs test about the middle of the alphabet, and the correlation of neighbours. Fisher's method
combines the three p-values. Random strings have evenly spread p-values, words and identifiers small ones.

*False discoveries.* A string of n characters passes by itself if its p-value is 1 / n or more, however few its like are. Those
that pass are counted over all documents by encoding, length band and p-value, scaled to 0 to 1. Random strings fill the lower
and the upper half of any tail alike, so what the lower half has more, signed and summed, estimates the others (Storey's estimate
of each tail); the threshold is the least one that keeps them at or below the share ``FDR`` of the accepted and one standard deviation
of that difference. In simulated bands of 1, 10, 100 and 1,000 random strings 100, 92, 99 and 100 % of those that pass by themselves are
accepted; bands in which words pass too get higher thresholds.

Matches leave their text as rows: running sums give their places, running extremes tell which strings touch a span, so the time grows with
the matches of a text as a sort does. A very long text is scanned by one task; its spans come back as one array of the result.

Positions are code points, ends exclusive. Defined results: null and empty texts have no spans; repeated rows are scanned
each; a null id is returned as null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.plans.store import materialise

_WORD = r"(?i:password|passwd|secret|token|api_?key)"
_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"{_WORD}[\"']?\x20*[:=]\x20*[\"']?{_VALUE}"
ASSIGN_VALUE = rf"^{_WORD}[\"']?\x20*[:=]\x20*[\"']?({_VALUE})$"
#: Runs that are too short fail as a whole, so the least length can stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_LENGTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}"
#: The pieces of a run that fits no alphabet: between all four signs, and those between the standard or the URL-safe ones that hold no such piece.
_INNER = f"[A-Za-z0-9]{{{MIN_LENGTH}}}"
PIECES = {
    "inner": rf"(?<![A-Za-z0-9]){_INNER}[A-Za-z0-9]*={{0,2}}",
    **{name: rf"(?<![{signs}])(?![{signs}]*?{_INNER})[{signs}]{{{MIN_LENGTH},}}={{0,2}}" for name, signs in (("url_piece", "A-Za-z0-9_-"), ("standard_piece", "A-Za-z0-9+/"))},
}
#: Alphabets in the order in which they are tried.
ENCODINGS = {
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36_lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64_url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
FDR = 0.05
#: Cells of the histogram of p-values.
CELLS = 20
KINDS = ["assign", "access", "hex", "random"]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches(kind: str, pattern: str, text: str) -> str:
    """SQL for ``array<struct<kind,gap,value>>``: the matches of a pattern in order, each with the characters since the one before."""
    pieces = f"zip_with(found, split({text}, {_quoted(pattern)}, -1), (m, p) -> named_struct('kind', '{kind}', 'gap', length(p), 'value', m))"
    none = "cast(array() AS array<struct<kind:string,gap:int,value:string>>)"
    return f"element_at(transform(array(regexp_extract_all({text}, {_quoted(pattern)}, 0)), found -> CASE WHEN size(found) = 0 THEN {none} ELSE filter({pieces}, x -> x.value IS NOT NULL) END), 1)"


def located(rows: DataFrame, found: list[str], within: list[str], at: Column) -> DataFrame:
    """A row per match of the arrays ``found``: ``(row, id, kind, start, end, value)``; gaps and lengths are summed up from ``at``."""
    each = rows.select("row", "id", *within, F.posexplode(F.expr(f"concat({', '.join(found)})")).alias("pos", "m")).select("row", "id", *within, "pos", "m.*")
    so_far = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", *within, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = (at + so_far).cast("int")
    return each.repartition("row").select("row", "id", "kind", (end - F.length("value")).alias("start"), end.alias("end"), "value")


def _upper_tail(z: str) -> str:
    """1 - Phi(z) by a logistic curve of a cubic (error below 2e-4)."""
    return f"(1 / (1 + exp(least(700D, greatest(-700D, 1.5976 * ({z}) + 0.07056 * pow({z}, 3))))))"


def battery(value: str) -> str:
    """SQL for ``struct<encoding,length,p>`` of one candidate string."""
    body = f"rtrim('=', {value})"
    names = " ".join(f"WHEN rlike(b, '^[{alphabet.replace('-', chr(92) * 2 + '-')}]+$') THEN '{name}'" for name, alphabet in ENCODINGS.items())
    symbols = " ".join(f"WHEN e = '{name}' THEN '{alphabet}'" for name, alphabet in ENCODINGS.items())
    # each step hands a struct to the next one, as SQL lambdas have no local names
    steps = [
        f"transform(array({body}), b -> named_struct('b', b, 'e', CASE {names} ELSE 'mixed' END))",
        f"transform({{0}}, s -> named_struct('e', s.e, 'n', length(s.b), 'c', split(s.b, ''), 'a', CASE {symbols.replace('e = ', 's.e = ')} ELSE '' END))",
        "transform(filter({0}, s -> s.e <> 'mixed'), s -> named_struct('e', s.e, 'n', s.n, 'k', length(s.a), 'd', transform(array_distinct(s.c), x -> size(filter(s.c, y -> y = x))), 'v', transform(s.c, x -> instr(s.a, x) - 1)))",
        "transform({0}, s -> named_struct('e', s.e, 'n', s.n, 'k', s.k, 'x2', s.k * 1D / s.n * aggregate(s.d, 0D, (t, x) -> t + x * x) - s.n, 'n1', size(filter(s.v, x -> 2 * x >= s.k)),"
        " 'r', 1 + size(filter(zip_with(slice(s.v, 1, s.n - 1), slice(s.v, 2, s.n - 1), (x, y) -> (2 * x >= s.k) <> (2 * y >= s.k)), t -> t)), 'm', aggregate(s.v, 0D, (t, x) -> t + x) / s.n, 'v', s.v))",
        "transform({0}, s -> named_struct('e', s.e, 'n', s.n, 'df', s.k - 1D, 'x2', s.x2, 'n1', s.n1 * 1D, 'n2', (s.n - s.n1) * 1D, 'r', s.r,"
        " 'top', aggregate(zip_with(slice(s.v, 1, s.n - 1), slice(s.v, 2, s.n - 1), (x, y) -> (x - s.m) * (y - s.m)), 0D, (t, x) -> t + x), 'low', aggregate(s.v, 0D, (t, x) -> t + (x - s.m) * (x - s.m))))",
        "transform({0}, s -> named_struct('e', s.e, 'n', s.n, 'z1', (pow(s.x2 / s.df, 1 / 3D) - (1 - 2 / (9 * s.df))) / sqrt(2 / (9 * s.df)),"
        " 'z2', CASE WHEN s.n1 * s.n2 < 2 THEN 9D ELSE (s.r - 1 - 2 * s.n1 * s.n2 / s.n) / sqrt(2 * s.n1 * s.n2 * (2 * s.n1 * s.n2 - s.n) / (1D * s.n * s.n * (s.n - 1)) + 1e-12) END,"
        " 'z3', CASE WHEN s.low = 0 THEN 9D ELSE s.top / s.low * sqrt(s.n) + 1 / sqrt(s.n) END))",
        f"transform({{0}}, s -> named_struct('e', s.e, 'n', s.n, 'h', - ln(greatest(1e-300D, {_upper_tail('s.z1')})) - ln(greatest(1e-300D, 2 * {_upper_tail('abs(s.z2)')})) - ln(greatest(1e-300D, 2 * {_upper_tail('abs(s.z3)')}))))",
        "element_at(transform({0}, s -> named_struct('encoding', s.e, 'length', s.n, 'p', least(1D, exp(- s.h) * (1 + s.h + s.h * s.h / 2)))), 1)",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = step.replace("{0}", out)
    return out


#: Least p-value of a single string, and p-values of those that pass, even from 0 to 1 if they are random.
_LEAST = "(1D / test.length)"
_SCALED = f"((test.p - {_LEAST}) / (1 - {_LEAST}))"
_CELL = "concat(test.encoding, ':', cast(floor(log2(test.length)) AS int))"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, id, matches)``: one row per text with the matches of all patterns; texts are left behind."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.expr(f"concat({', '.join(matches(k, p, 'text') for k, p in patterns.items())})").alias("matches"))


def candidates(scanned: DataFrame) -> DataFrame:
    """``(row, id, kind, start, end, value, test)``: spans of the patterns, and tested strings that overlap none of them."""
    found = materialise(located(scanned.where("size(matches) > 0"), ["matches"], [], F.lit(0)))
    base = found.where("kind <> 'random'").where(f"kind <> 'assign' OR length(regexp_extract(value, {_quoted(ASSIGN_VALUE)}, 1)) >= 6")
    mixed = F.expr("value rlike '[+/]' AND value rlike '[_-]'")
    runs = found.where("kind = 'random'")
    parts = [matches(name, pattern, "value") for name, pattern in PIECES.items()]
    pieces = located(runs.where(mixed).withColumnRenamed("start", "at"), parts, ["at"], F.col("at")).withColumn("kind", F.lit("random"))
    strings = runs.where(~mixed).unionByName(pieces).where("value rlike '[0-9]' AND value rlike '[A-Za-z]'")
    # a string is free if no span that starts before it reaches into it and the next one starts behind it
    spans, by_start = F.col("kind") != "random", Window.partitionBy("row").orderBy
    reach = F.max(F.when(spans, F.col("end"))).over(by_start("start"))
    following = F.min(F.when(spans, F.col("start"))).over(by_start(F.desc("start")))
    free = base.unionByName(strings).withColumns({"reach": reach, "following": following}).where(
        "kind <> 'random' OR (coalesce(reach, 0) <= start AND coalesce(following, end) >= end)")
    return free.select("row", "id", "kind", "start", "end", "value", F.expr(f"CASE WHEN kind = 'random' THEN {battery('value')} END").alias("test"))


def least_cell(n: list[int], fdr: float = FDR) -> int | None:
    """First cell of the longest accepted tail of a histogram of scaled p-values."""
    for cell in range(CELLS - 1):
        half, total = (CELLS - cell) // 2, sum(n[cell:])
        if total and sum(n[cell:cell + half]) - sum(n[CELLS - half:]) <= fdr * total + total**0.5:
            return cell
    return None


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """Least accepted scaled p-value by encoding and length band; bands that accept nothing are missing."""
    one = tested.where("kind = 'random'").select(F.expr(_CELL).alias("band"), F.expr(_SCALED).alias("scaled")).where("scaled >= 0")
    one = one.select("band", F.least(F.floor(F.col("scaled") * CELLS), F.lit(CELLS - 1)).alias("cell"))
    counts: dict[str, list[int]] = {}
    for r in one.groupBy("band", "cell").count().collect():  # encodings x length bands x cells, whatever the input
        counts.setdefault(r["band"], [0] * CELLS)[r["cell"]] = r["count"]
    cells = {band: least_cell(n, fdr) for band, n in counts.items()}
    return {band: cell / CELLS for band, cell in cells.items() if cell is not None}


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``id_col, spans`` with ``spans array<struct<kind,start,end,value>>`` by start, then kind in the order of ``KINDS``."""
    scanned = materialise(scan(docs, id_col, text_col))
    tested = materialise(candidates(scanned))
    least = thresholds(tested, fdr)
    table = "map(" + ", ".join(f"'{k}', {v}D" for k, v in sorted(least.items())) + ")" if least else "cast(map() AS map<string,double>)"
    rank = f"array_position(array({', '.join(repr(k) for k in KINDS)}), kind)"
    kept = tested.where(f"kind <> 'random' OR {_SCALED} >= coalesce({table}[{_CELL}], 2D)").select("row", "id", F.struct("start", F.expr(rank).alias("rank"), "end", "kind", "value").alias("span"))
    # texts without a match are not shuffled; one whose matches all fail keeps its row through a null span
    some = scanned.where("size(matches) > 0").select("row", "id", F.lit(None).cast(kept.schema["span"].dataType).alias("span")).unionByName(kept)
    spans = some.groupBy("row", "id").agg(F.sort_array(F.collect_list("span")).alias("spans")).select(
        F.col("id").alias(id_col), F.expr("transform(spans, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', x.value))").alias("spans"))
    none = scanned.where("size(matches) = 0").select(F.col("id").alias(id_col), F.array().cast(spans.schema["spans"].dataType).alias("spans"))
    return none.unionByName(spans)


def digest(spans_col: str) -> str:
    """SQL for ``kind:start:end`` of each span, comma-joined."""
    return f"array_join(transform({spans_col}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
