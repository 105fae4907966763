"""Matching of share lines of two vendors that have no key in common.

1. Both sides become lines: one row per Ticker or permno with its names, industries, exchanges and its quarters in order, each with
   return and market value. A line has at most one entry per quarter of the calendar, however many rows were delivered; quarters that
   it lacks take no room.
2. Candidate pairs come from one equi-join on hashed blocking keys. Every key needs several attributes of the same quarter at once, so
   that neither a frequent name nor a frequent value pairs all its bearers (BLOCKS says which). Market values are binned by the logarithm
   modulo ln 1000, so values in another unit, a thousand times off, fall into the same bin. A line has some keys for each of its quarters
   and needs one of them in common with its partner; a value that just misses its bin in one quarter meets in another.
3. Each pair is judged by the functions VOTERS, each of which may abstain; labelmodel learns their accuracies and dependencies from
   the counts of their vote patterns (at most 3 ** len(VOTERS) rows, so the driver's share is bounded) and gives each pattern its
   posterior, the confidence.
4. One line may have several partners only one after the other (a Ticker that changed): of pairs that share a line in overlapping
   quarters, the one with more confidence, then more agreeing values, stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpanel.functions.numeric import is_finite
from textpanel.functions.text import clean_ric

from . import labelmodel
from textpanel.plans.storage import stored

#: How the vendors shorten words of names.
SHORT = {
    "INTL": "INTERNATIONAL", "MATLS": "MATERIALS", "RES": "RESOURCES", "MTRS": "MOTORS", "INDS": "INDUSTRIES", "FINL": "FINANCIAL", "SYS": "SYSTEMS",
    "PETE": "PETROLEUM", "HLDGS": "HOLDINGS", "HLDG": "HOLDINGS", "HOLDING": "HOLDINGS", "TR": "TRUST", "GRP": "GROUP", "CO": "COMPANY", "CORP": "CORPORATION",
    "INC": "INCORPORATED", "LTD": "LIMITED",
}
LEGAL = ("INCORPORATED", "CORPORATION", "LIMITED", "COMPANY", "TRUST", "GROUP", "HOLDINGS")
UNIT = math.log(1000)
CAP_NEAR, RET_NEAR, TRACE = 0.08, 0.05, 6
VOTERS = ("name", "trade", "legal", "share_class", "industry", "exchange", "caps", "returns", "trace", "period")
#: What a blocking key is made of: attributes, and the width of the bin of the market value's logarithm and of the returns (of how many
#: quarters in a row). The narrower the bins, the fewer strangers meet; the wider, the more partners do. A `form` is the first word with at
#: most one letter left out, on lines with less than SHORT_LINE full quarters, which have few chances to meet otherwise. `nameless` is for
#: lines of the second side that have no name at all.
BLOCKS = {"value": ("first", 0.03, None, 0), "both": ("first", 0.1, 0.05, 1), "returns": ("first", None, 0.01, 2), "industry": ("sic", 0.2, 0.01, 2), "run": (None, 0.2, 0.005, 3), "nameless": (None, 0.2, 0.02, 3), "near": ("form", 0.2, 0.02, 1), "near value": ("form", 0.05, None, 0), "near return": ("form", None, 0.05, 1)}
SHORT_LINE = 6


def _plain(c: Column) -> Column:
    """Upper case without accents (Latin letters)."""
    return F.translate(F.upper(c), "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ", "AAAAAAEEEEIIIIOOOOOUUUUCNY")


def name_words(c: Column) -> Column:
    """Words of a company name in upper case without accents, leading article and punctuation; known short forms in full."""
    words = F.filter(F.split(F.regexp_replace(_plain(c), r"[^A-Z0-9]+", " "), " "), lambda w: (w != "") & (w != "THE"))
    full = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w))


def _class_of(words: Column) -> Column:
    """The letter of a share class, if the name ends with one (CLASS A, CL A, - A)."""
    last = F.try_element_at(words, F.lit(-1))
    return F.when((F.size(words) > 2) & (F.length(last) == 1), last)


def _named(words: Column) -> Column:
    """What is kept of one form of a name: first word, the other words of its trade, legal form, class."""
    legal = F.array(*[F.lit(x) for x in LEGAL])
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    trade = F.filter(rest, lambda w: ~F.array_contains(legal, w) & (F.length(w) > 1) & ~w.isin("CL", "CLASS"))
    return F.struct(F.try_element_at(words, F.lit(1)).alias("first"), trade.alias("trade"), F.array_intersect(rest, legal).alias("legal"), _class_of(words).alias("cls"))


def _described(names: Column, sic: Column, ex: Column) -> list[Column]:
    """Columns firsts, trade, legal, cls, sic, ex from arrays of a line's names, industries and exchanges."""
    forms = F.transform(F.filter(F.transform(names, name_words), lambda w: F.size(w) > 0), _named)
    each = lambda field: F.transform(forms, lambda x: x[field])
    flat = lambda field: F.array_distinct(F.flatten(each(field))).alias(field)
    return [F.array_distinct(each("first")).alias("firsts"), flat("trade"), flat("legal"), F.array_compact(F.array_distinct(each("cls"))).alias("cls"), sic.alias("sic"), ex.alias("ex")]


def _quarter() -> Column:
    nan = F.lit(float("nan"))
    return F.struct("q", F.coalesce("ret", nan).cast("float").alias("r"), F.coalesce("cap", nan).cast("float").alias("c"))


def vendor_lines(panel: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(ticker, s, descriptions) of the panel's Tickers that are listed on an exchange that `exchanges` gives a primaryexch. s: quarters in
    order, each with return r and logarithm of the market value c, NaN where there is none; of repeated quarters the least values."""
    listed = exchanges.filter("primaryexch IS NOT NULL").select(F.upper("suffix").alias("suffix"), F.col("primaryexch").alias("exch")).distinct()
    quarter = (F.year("Quarter") * 4 + F.quarter("Quarter") - 1).cast("int")
    p = panel.select(clean_ric("Ticker").alias("ticker"), quarter.alias("q"), "companyName", "siccd", "QuarterlyRet", "MCap_QEnd").filter("ticker IS NOT NULL AND q IS NOT NULL")
    p = p.withColumn("suffix", F.when(F.instr("ticker", ".") > 0, F.substring_index("ticker", ".", -1))).join(listed, "suffix", "inner")
    cap = F.when(is_finite("MCap_QEnd") & (F.col("MCap_QEnd") > 0), F.ln("MCap_QEnd"))
    one = p.groupBy("ticker", "q").agg(F.min(F.when(is_finite("QuarterlyRet"), F.col("QuarterlyRet"))).alias("ret"), F.min(cap).alias("cap"), *[F.collect_set(c).alias(c) for c in ("companyName", "siccd", "exch")])
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    line = one.groupBy("ticker").agg(F.array_sort(F.collect_list(_quarter())).alias("s"), *[gathered(c) for c in ("companyName", "siccd", "exch")])
    return line.select("ticker", "s", *_described(F.col("companyName"), F.col("siccd"), F.col("exch")))


def security_lines(returns: DataFrame, names: DataFrame) -> DataFrame:
    """(permno, s, descriptions), like vendor_lines, of every permno that has a row with a month."""
    line = security_quarters(returns).groupBy("permno").agg(F.array_sort(F.collect_list(_quarter())).alias("s"))
    d = names.filter("permno IS NOT NULL").groupBy("permno").agg(*[F.collect_set(c).alias(c) for c in ("comnam", "siccd", "primaryexch")]).select("permno", *_described(F.col("comnam"), F.col("siccd"), F.col("primaryexch")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return line.join(d, "permno", "left").select("permno", "s", *[none(F.col(c), "string").alias(c) for c in ("firsts", "trade", "legal", "cls")], none(F.col("sic"), "int").alias("sic"), none(F.col("ex"), "string").alias("ex"))


def security_quarters(returns: DataFrame) -> DataFrame:
    """(permno, q, ret, cap): compounded return of quarters with three months, market value (million) at the last month."""
    ok = returns.filter("permno IS NOT NULL AND Month IS NOT NULL").select("permno", (F.year("Month") * 12 + F.month("Month") - 1).cast("int").alias("t"), F.when(is_finite("RetM") & (F.col("RetM") > -1), F.col("RetM")).alias("r"), F.when(is_finite("MCap_MEnd") & (F.col("MCap_MEnd") > 0), F.col("MCap_MEnd")).alias("m"))
    # After the first aggregate a security has no more rows than there are months, so it may be one task's: no later step shuffles again.
    month = ok.groupBy("permno", "t").agg(F.min("r").alias("r"), F.min("m").alias("m")).repartition("permno")
    q = F.floor(F.col("t") / 3).cast("int")
    g = month.groupBy("permno", q.alias("q")).agg(F.count("r").alias("n"), F.sum(F.log1p("r")).alias("s"), F.max_by("m", F.when(F.col("m").isNotNull(), F.col("t"))).alias("m"))
    return g.select("permno", "q", F.when(F.col("n") == 3, F.expm1("s")).alias("ret"), F.ln(F.col("m") / 1000).alias("cap"))


def blocking_keys(lines: DataFrame, line: str, nameless: bool) -> DataFrame:
    """(line, key): every blocking key of every line, as a hash: of two lines with an equal key, a few may share no attribute, and are
    voted down. `nameless`: whether this side gives the keys of that name only for its lines without a name."""
    full = F.size(F.filter("s", lambda x: ~F.isnan(x["r"]) & ~F.isnan(x["c"])))
    less = lambda w: F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))))
    sources = {
        "first": lines.select(line, "s", F.explode("firsts").alias("of")),
        "sic": lines.select(line, "s", F.explode("sic").alias("of")),
        "form": lines.filter(full < SHORT_LINE).select(line, "s", F.explode(F.array_distinct(F.flatten(F.transform("firsts", less)))).alias("of")).filter("of <> ''"),
        None: lines.select(line, "s", (F.size("firsts") == 0).alias("of")),
    }
    parts = []
    for source, rows in sources.items():
        at = rows.select(line, "of", F.posexplode("s").alias("i", "x"), "s").select(line, "of", "x", *[F.get("s", F.col("i") + k).alias(f"x{k}") for k in (1, 2)])
        keys = []
        for name, (attribute, cap_bin, ret_bin, run) in BLOCKS.items():
            if attribute != source:
                continue
            needed, hashed = [], [F.lit(name), F.col("x.q")]
            if attribute:
                hashed.append(F.col("of"))
            elif name == "nameless" and nameless:
                needed.append(F.col("of"))
            if cap_bin:
                c = F.col("x.c").cast("double")
                needed.append(~F.isnan(c))
                hashed.append(F.floor(F.pmod(c, F.lit(UNIT)) / cap_bin))
            for k in range(run):
                x = F.col("x" if k == 0 else f"x{k}")
                r = x["r"].cast("double")
                needed += [x.isNotNull(), x["q"] == F.col("x.q") + k, ~F.isnan(r)]
                hashed.append(F.floor(r / ret_bin))
            ok = needed[0]
            for n in needed[1:]:
                ok = ok & n
            keys.append(F.when(ok, F.xxhash64(*hashed)))
        parts.append(at.select(line, F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (ticker, permno) of lines with a blocking key in common."""
    return blocking_keys(a, "ticker", nameless=False).join(blocking_keys(b, "permno", nameless=True), "key").select("ticker", "permno").distinct()


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the quarters of both lines. Instead of them: quarters in which both have a value and in which they agree, for
    market values and returns; first and last agreeing quarter (0 if there is none)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        sides = []
        for column in (batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
            flat = column.flatten()
            pair = np.repeat(np.arange(n, dtype=np.int64), column.value_lengths().to_numpy(zero_copy_only=False))
            q, r, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sides.append(((pair << 32) + q, r, c))
        (ka, ra, ca), (kb, rb, cb) = sides
        common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        pair, quarter = common >> 32, common & 0xFFFFFFFF
        with np.errstate(invalid="ignore"):
            d, e = ca[ia] - cb[ib], np.abs(ra[ia] - rb[ib])
            both_c, both_r = ~np.isnan(d), ~np.isnan(e)
            ok_c = np.abs(d - np.round(d / UNIT) * UNIT) < CAP_NEAR
            ok_r = e < RET_NEAR
        count = lambda mask: np.bincount(pair[mask], minlength=n)
        first, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        any_ok = ok_c | ok_r
        last[pair[any_ok]] = quarter[any_ok]  # in order of quarters: the last one stays
        first[pair[any_ok][::-1]] = quarter[any_ok][::-1]
        added = dict(zip(("n_c", "ok_c", "n_r", "ok_r", "from_q", "to_q"), (count(both_c), count(ok_c), count(both_r), count(ok_r), first, last), strict=True))
        kept = batch.schema.names[:-2]
        yield pa.record_batch([*(batch.column(k) for k in range(len(kept))), *(pa.array(v, pa.int64()) for v in added.values())], names=[*kept, *added])


def _ternary(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def voted_pairs(panel: DataFrame, returns: DataFrame, names: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(ticker, permno, one column per voter, agree, from_q, to_q) of every candidate pair."""
    a, b = stored(vendor_lines(panel, exchanges)), stored(security_lines(returns, names))  # read by each kind of key, and once more
    pairs = candidates(a, b)
    side = lambda d, key, s: d.select(key, *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c != key])
    met = pairs.join(side(a, "ticker", "a"), "ticker").join(side(b, "permno", "b"), "permno")

    def sets(c: str, like: Callable[[Column, Column], Column] | None = None) -> Column:
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        some = (F.size(x) > 0) & (F.size(y) > 0)
        same = F.arrays_overlap(x, y)
        if like:
            same = same | F.exists(x, lambda p: F.exists(y, lambda q: like(p, q)))
        return _ternary(some & same, some & ~same)

    near = lambda p, q: F.levenshtein(p, q) <= 1
    begins = lambda p, q: (F.least(F.length(p), F.length(q)) >= 3) & (p.startswith(q) | q.startswith(p) | near(p, q))
    q0, q1 = (lambda s: F.get(s, F.lit(0))["q"]), (lambda s: F.element_at(s, -1)["q"])
    inside = F.least(q1("s_a"), q1("s_b")) - F.greatest(q0("s_a"), q0("s_b")) + 1
    length = q1("s_a") - q0("s_a") + 1
    judged = met.select("ticker", "permno", sets("firsts", near).alias("name"), sets("trade", begins).alias("trade"), sets("legal").alias("legal"), sets("cls").alias("share_class"), sets("sic").alias("industry"), sets("ex").alias("exchange"), _ternary(inside >= length * 0.9, inside < length * 0.5).alias("period"), "s_a", "s_b")
    kept = judged.schema[:-2]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{c} bigint" for c in ("n_c", "ok_c", "n_r", "ok_r", "from_q", "to_q")])
    s = judged.mapInArrow(_agreement, schema)
    caps = _ternary((F.col("n_c") > 0) & (F.col("ok_c") >= 0.6 * F.col("n_c")), (F.col("n_c") > 0) & (F.col("ok_c") < 0.4 * F.col("n_c")))
    rets = _ternary((F.col("n_r") > 0) & (F.col("ok_r") >= 0.6 * F.col("n_r")), (F.col("n_r") > 0) & (F.col("ok_r") < 0.4 * F.col("n_r")))
    trace = _ternary((F.col("ok_c") >= TRACE) & (F.col("ok_c") >= 0.6 * F.col("n_c")), (F.col("n_c") >= 3) & (F.col("ok_c") < 0.6 * F.col("n_c")))
    return s.select("ticker", "permno", "name", "trade", "legal", "share_class", "industry", "exchange", caps.alias("caps"), rets.alias("returns"), trace.alias("trace"), "period", (F.col("ok_c") + F.col("ok_r")).cast("int").alias("agree"), F.col("from_q").cast("int").alias("from_q"), F.col("to_q").cast("int").alias("to_q"))


def confident_pairs(voted: DataFrame) -> DataFrame:
    """Adds `confidence`, the label model's posterior. `voted` should be stored: it is read twice."""
    counts = voted.groupBy(*VOTERS).count().toPandas()  # at most 3 ** len(VOTERS) rows
    patterns = counts[list(VOTERS)].to_numpy(dtype=int).reshape(-1, len(VOTERS))
    model = labelmodel.fit(patterns, counts["count"].to_numpy())
    spark = voted.sparkSession
    rows = [(*map(int, p), float(x)) for p, x in zip(patterns, model.posterior(patterns), strict=True)]
    scored = spark.createDataFrame(rows, ", ".join(f"{v} tinyint" for v in VOTERS) + ", confidence double")
    return voted.join(F.broadcast(scored), list(VOTERS))  # broadcast: bounded as above


def _unrivalled(pairs: DataFrame, line: str, other: str) -> DataFrame:
    """Per line, the best pair and those whose agreeing quarters lie wholly before or after the best one's."""
    best = Window.partitionBy(line).orderBy(F.col("confidence").desc(), F.col("agree").desc(), F.col(other))
    ranked = pairs.withColumn("_r", F.row_number().over(best)).withColumn("_f", F.first("from_q").over(best)).withColumn("_t", F.first("to_q").over(best))
    return ranked.filter((F.col("_r") == 1) | (F.col("to_q") < F.col("_f")) | (F.col("from_q") > F.col("_t"))).drop("_r", "_f", "_t")


def matches(confident: DataFrame, least: float = 0.8) -> DataFrame:
    """(ticker, permno, confidence, agree, ...) of the pairs with at least that confidence, each line with one partner at a time."""
    kept = confident.filter(F.col("confidence") >= least)
    return _unrivalled(_unrivalled(kept, "ticker", "permno"), "permno", "ticker")
