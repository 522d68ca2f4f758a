"""Counterparties: cleaned rows, canonical names, activity profiles and selection."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions.calendar import month_end, month_end_tail, month_start
from ..functions.labels import amount_bin, bin_label, ladder, sbc_label
from ..functions.parsing import parse_amount, parse_date
from ..functions.text import (
    NO_COMPANY,
    extract_company,
    first_non_empty_text,
    normalize_company,
    simple_company_name,
)
from ..session import ensure_checkpoint_dir
from ..sources.layers import Layers
from . import stats as T
from .gold import TRADE, VALUE
from .keyed import Keyed, entropy, per_key
from .quantiles import attach, exact_quantiles, percent_ranks
from .silver import drop_id_duplicates

# Text columns that may name the counterparty, in order of preference.
TEXT_CANDIDATES = ("LABEL", "DESCRIPTION", "CPTY_NAME", "CPTY_SHORTNAME")


def company_columns(df: DataFrame, existing: str = "company_name", candidates=TEXT_CANDIDATES, spaced_digits=True) -> DataFrame:
    """company_name (given, else extracted), company_found and company_key."""
    texts = [c for c in candidates if c in df.columns]
    extracted = normalize_company(extract_company(first_non_empty_text(*texts)), spaced_digits)
    given = normalize_company(existing, spaced_digits) if existing in df.columns else F.lit(None).cast("string")
    name = F.coalesce(given, extracted)
    return df.withColumn("company_name", name).withColumns(
        {"company_found": F.col("company_name").isNotNull(), "company_key": F.coalesce("company_name", F.lit(NO_COMPANY))}
    )


def clean_movement_extract(df: DataFrame, movement_value: str | None = None, amount: str = "SIGNED_AMOUNT",
                           movement: str = "CASH_MOVEMENT_TYPE_SHORTNAME", candidates=TEXT_CANDIDATES) -> DataFrame:
    """Rows of one movement type, typed, one per ID, with company, bin and calendar columns."""
    rows = df if movement_value is None else df.filter(F.col(movement) == movement_value)
    typed = {}
    for name, kind in rows.dtypes:
        if name.endswith("_DATE"):
            typed[name] = parse_date(name) if kind == "string" else F.col(name).cast("date")
        elif name in ("AMOUNT", "SIGNED_AMOUNT", "ORIGIN_AMOUNT") and kind == "string":
            typed[name] = parse_amount(name)
    rows = drop_id_duplicates(rows.withColumns(typed) if typed else rows)
    rows = company_columns(rows, candidates=candidates).withColumn("amount", F.col(amount).cast("double"))
    rows = rows.filter(F.col("amount").isNotNull() & F.col(VALUE).isNotNull())
    return rows.withColumns(
        {
            "abs_amount": F.abs("amount"),
            "amount_bin": amount_bin(F.abs("amount")),
            "dayofweek": F.weekday(VALUE),
            "day_name": F.date_format(VALUE, "EEEE"),
            "dayofmonth": F.day(VALUE),
        }
    )


# --- canonical names -----------------------------------------------------------------------


def _indel_similarity(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), the LCS by bit-parallel rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - bin(row).count("1")
    return 200.0 * lcs / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_indel_similarity(x, y) for x, y in zip(a, b)])


def _segment_columns(text: Column, size: Column, threshold: int):
    """Segments of the shorter name: with d edits allowed, one of d+1 segments stays intact."""
    slack = (100 - threshold) / 100.0
    longest = F.floor(size * (1 + slack) / (1 - slack) + 1e-9)
    edits = F.floor(slack * (size + longest) + 1e-9).cast("int")
    parts = F.least(edits + 1, size)
    cut = lambda i: F.floor(i * size / parts).cast("int")
    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda i: F.struct(size.alias("l"), i.alias("i"), F.substr(text, cut(i) + 1, cut(i + 1) - cut(i)).alias("s")),
    )


def _probe_columns(text: Column, size: Column, threshold: int, l: Column):
    """Substrings of the longer name that could equal a segment of a name of length l."""
    slack = (100 - threshold) / 100.0
    longest = F.floor(l * (1 + slack) / (1 - slack) + 1e-9)
    edits = F.floor(slack * (l + longest) + 1e-9).cast("int")
    parts = F.least(edits + 1, l)
    cut = lambda i: F.floor(i * l / parts).cast("int")

    def per_part(i):
        width = cut(i + 1) - cut(i)
        first = F.greatest(F.lit(0), cut(i) - edits)
        last = F.least(size - width, cut(i) + edits)
        starts = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(l.alias("l"), i.alias("i"), F.substr(text, p + 1, width).alias("s")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), per_part)))


#: Letters taken off a name, and keys a name may have for that, before segments are used in their place.
MOST_DELETED, MOST_KEYS = 2, 300


def _length_pairs(lengths, threshold: int) -> list[tuple[int, int, int]]:
    """(l, m, deleted): lengths that can be similar, and the letters to take off a name of length l before it can
    equal one of length m with letters taken off; -1 where that gives too many keys on either side."""
    slack = (100 - threshold) / 100.0
    out = []
    for l in lengths:
        for m in lengths:
            edits = math.floor(slack * (l + m) + 1e-9)
            if abs(l - m) <= edits:
                common = (l + m - edits + 1) // 2
                few = all(n - common <= MOST_DELETED and math.comb(n, n - common) <= MOST_KEYS for n in (l, m))
                out.append((l, m, l - common if few else -1))
    return out


def _shortened(text: Column, deleted: int) -> Column:
    """The different texts that are left when that many letters are taken off."""
    out = F.array(text)
    for _ in range(deleted):
        without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
        out = F.array_distinct(F.flatten(F.transform(out, without)))
    return out


def similar_pairs(left: DataFrame, right: DataFrame, threshold: int, small_left: bool = False) -> DataFrame:
    """Exact pairs (a, b) with similarity of sorted tokens at or above the threshold.

    Similar names of lengths l and m have a text in common that is left when few letters are taken off each. Where a
    name has few such texts, they are the join key, which only similar names share. Other lengths meet by (length of
    the shorter name, segment number, segment text); by the pigeonhole rule no similar pair is missed.
    ``small_left`` says that the left names are few enough for every task.
    """
    spark = left.sparkSession
    size = F.length("t").cast("int")
    # One row per length of a name.
    lengths = sorted(r["n"] for r in left.select(size.alias("n")).union(right.select(size.alias("n"))).distinct().collect())
    pairs = _length_pairs(lengths, threshold)
    spread = F.broadcast if small_left else (lambda d: d)
    met = []

    def sized(d: DataFrame, rows, columns: str, n: str) -> DataFrame:
        of = spark.createDataFrame(rows, columns)
        return d.select(F.col("name").alias(n), F.col("t").alias(f"t_{n}"), size.alias("n")).join(F.broadcast(of), "n")

    close = [p for p in pairs if p[2] >= 0]
    if close:
        def keyed(d: DataFrame, n: str) -> DataFrame:
            text = F.col(f"t_{n}")
            texts = F.when(F.col("deleted") == 0, _shortened(text, 0)).when(F.col("deleted") == 1, _shortened(text, 1)).otherwise(_shortened(text, 2))
            rows = sized(d, close, "n int, m int, deleted int", n).withColumn("s", F.explode(texts))
            return rows.select(n, f"t_{n}", F.xxhash64(F.least("n", "m"), F.greatest("n", "m"), "s").alias("k"))

        met.append(spread(keyed(left, "a")).join(keyed(right, "b"), "k"))
    far = [(m, l) for l, m, deleted in pairs if deleted < 0 and l <= m]  # longer, shorter
    if far:
        shorter = [(l,) for l in sorted({l for _, l in far})]
        index = lambda d, n: sized(d, shorter, "n int", n).select(n, f"t_{n}", F.explode(_segment_columns(F.col(f"t_{n}"), F.col("n"), threshold)).alias("k"))
        probe = lambda d, n: sized(d, far, "n int, l int", n).select(n, f"t_{n}", F.explode(_probe_columns(F.col(f"t_{n}"), F.col("n"), threshold, F.col("l"))).alias("k"))
        met += [spread(index(left, "a")).join(probe(right, "b"), "k"), spread(probe(left, "a")).join(index(right, "b"), "k")]
    if not met:
        return left.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    found = met[0].select("a", "b", "t_a", "t_b")
    for part in met[1:]:
        found = found.unionByName(part.select("a", "b", "t_a", "t_b"))
    found = found.distinct()
    la, lb = F.length("t_a"), F.length("t_b")
    near = found.filter(F.abs(la - lb) <= (100 - threshold) / 100.0 * (la + lb) + 1e-9)
    return near.filter(name_similarity("t_a", "t_b") >= threshold).select("a", "b")


#: Heads up to which every task gets all of them.
FEW_HEADS = 4_096


def canonicalize_names(tx: DataFrame, threshold: int = 90, overrides: dict[str, str] | None = None,
                       name: str = "company_name", first_heads: int = 64) -> DataFrame:
    """Mapping (name, canonical): names are visited by falling frequency and join the first
    earlier leader they resemble.

    Rounds over a prefix of open names that doubles each time. A head without an earlier open
    resembling head becomes a leader; a name follows its earliest resembling head when that is a
    leader, and waits otherwise. This follows the sequential rule in a few rounds, and names close to a
    frequent leader leave before they can meet each other. A name that waits for a head settled in the
    same round as a later leader it resembles misses that leader.
    """
    spark = tx.sparkSession
    ensure_checkpoint_dir(spark)
    sorted_tokens = F.array_join(F.array_sort(F.split(F.col("name"), " ")), " ")
    counts = tx.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    open_names = counts.select("name", sorted_tokens.alias("t"), F.struct((-F.col("n")).alias("n"), F.col("name").alias("x")).alias("o")).checkpoint()
    done, heads_wanted = None, first_heads
    while not open_names.isEmpty():
        heads = open_names.orderBy("o").limit(heads_wanted)
        order_of = open_names.select(F.col("name").alias("b"), F.col("o").alias("ob"))
        edges = (
            similar_pairs(heads, open_names, threshold, heads_wanted <= FEW_HEADS)
            .join(heads.select(F.col("name").alias("a"), F.col("o").alias("oa")), "a")
            .join(order_of, "b")
            .filter("oa < ob")
        )
        first = edges.groupBy(F.col("b").alias("name")).agg(F.min("oa").alias("first"))
        state = open_names.join(first, "name", "left").join(heads.select("name", F.lit(True).alias("head")), "name", "left").checkpoint()
        leaders = state.filter("head AND first IS NULL").select(F.col("name").alias("leader"))
        resolved = state.join(leaders, F.coalesce(F.col("first.x"), F.col("name")) == F.col("leader"), "left")
        settled = resolved.filter("leader IS NOT NULL").select("name", F.col("leader").alias("canonical"))
        done = settled if done is None else done.unionByName(settled)
        open_names = resolved.filter("leader IS NULL").select("name", "t", "o").checkpoint()
        heads_wanted *= 2
    if done is None:
        done = counts.select("name", F.col("name").alias("canonical"))
    for source, target in (overrides or {}).items():
        done = done.withColumn("canonical", F.when(F.col("name") == source, target).otherwise(F.col("canonical")))
    return done


def apply_canonical(tx: DataFrame, mapping: DataFrame) -> DataFrame:
    named = attach(tx, mapping.withColumnRenamed("name", "company_name"), ["company_name"])
    name = F.coalesce("canonical", "company_name")
    return named.withColumn("company_name", name).withColumns(
        {"company_found": F.col("company_name").isNotNull(), "company_key": F.coalesce("company_name", F.lit(NO_COMPANY))}
    ).drop("canonical")


# --- activity profiles on the calendar -----------------------------------------------------

AUTO_LAGS = (1, 7, 14, 28)
RECENT_DAYS = (30, 90, 180)


def profile_days(tx: DataFrame, keys, low: Column, high: Column, one_row_per_id: bool) -> DataFrame:
    """Sums per key, day and settlement lead, with the two ends of the calendar.

    Rows are summed once with map-side combine, so a hot key has at most the days times the leads of the calendar left.
    Where an ID may have several rows, its days are counted apart and come as lines of their own without rows.
    """
    lead = F.datediff(VALUE, TRADE)
    sums = [F.sum(F.col("amount").cast("double")).alias("_x"), F.count("*").alias("_c")]
    if one_row_per_id:
        days = tx.groupBy(*keys, VALUE, lead.alias("_l")).agg(*sums, F.count("ID").alias("_n"), F.max("company_found").alias("_f"))
    else:
        days = tx.groupBy(*keys, VALUE, lead.alias("_l")).agg(*sums, F.lit(0).cast("bigint").alias("_n"), F.max("company_found").alias("_f"))
        none = {"_l": "int", "_x": "double", "_f": "boolean"}
        ids = tx.groupBy(*keys, VALUE).agg(F.countDistinct("ID").alias("_n")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
        days = days.unionByName(ids.withColumn("_c", F.lit(0).cast("bigint")))
    ends = {"_lo": F.unix_date(low), "_hi": F.unix_date(high)}
    return days.withColumns({"_d": F.unix_date(VALUE), "_f": F.col("_f").cast("int"), **ends}).drop(VALUE)


def _profile_columns(stem: str) -> dict[str, str]:
    """Columns of a profile that follow from the days of a key, in their order; those with an underscore are parts of others."""
    names = ["total_amount", "total_abs_amount", f"mean_{stem}_amount", f"max_{stem}_amount", "cv2", "weekend_active_share", "month_start_active_share",
             "month_end_active_share", "rows_per_active_day_mean", "rows_per_active_day_max", "rows_per_active_day_cv2", *[f"autocorr_lag_{k}" for k in AUTO_LAGS],
             "median_gap_days", "mean_gap_days", "cv_gap_days", "min_gap_days", "max_gap_days", "lead_days_mean", "lead_days_median", "known_at_least_d1_share",
             "known_same_day_share", "_q50", "_q90", "_q95", "_top1", "_top3", "_spikes", "_dow_entropy", "_dow_top", "_dom_entropy", "_dom_top", "_diff",
             "_total_of", *[f"_recent_{n}" for n in RECENT_DAYS]]
    found = {"_found": "bigint", "row_count": "bigint", "active_days": "bigint"} | {n: "double" for n in names}
    return found | {"_run": "bigint", "_gap": "bigint", "_first": "date", "_last": "date"}


def _profile_measures(k: Keyed, absolute: bool, stem: str) -> dict:
    """The columns of a profile, each with the keys that have a value; the lines of a key are in the order of their days.

    Zero days are never built: everything the dense calendar would show follows from the active days and the
    two ends of the calendar.
    """
    (d, dated), (x, summed), (n, _), (c, _), (lead, led), (found, told), (lo, _), (hi, ended) = (
        k.values(name) for name in ("_d", "_x", "_n", "_c", "_l", "_f", "_lo", "_hi"))
    d, lo, hi = d.astype(np.int64), lo.astype(np.int64)[k.first], hi.astype(np.int64)[k.first]
    always = np.ones(k.n, dtype=bool)
    # Leads, each counted as often as it has rows.
    lead, times = lead.astype(np.int64), np.where(led, c, 0)
    rows = k.sum(times)
    part = lambda cond: (k.sum(np.where(cond, times, 0)) / rows, rows > 0)
    middle_lead, = k.quantiles(lead.astype(float), led & (times > 0), times, [0.5])
    # Lines of a day become one, and days without amount go.
    first = np.flatnonzero(np.concatenate([[True], (np.diff(k.of_row) != 0) | (np.diff(d) != 0) | (dated[1:] != dated[:-1])]))
    total, some, ids = np.add.reduceat(np.where(summed, x, 0.0), first), np.logical_or.reduceat(summed, first), np.add.reduceat(n, first)
    at = np.flatnonzero(some & (total != 0))
    x, n, of, d, dated = total[at], ids[at], k.of_row[first][at], d[first][at], dated[first][at]
    a = k.of_rows(of)
    ones, every, size = np.ones(len(x), dtype=np.int64), np.ones(len(x), dtype=bool), np.abs(x)
    v = size if absolute else x
    active, amount, abs_amount = a.sum(ones), a.sum(x), a.sum(size)
    some = active > 0
    _, mean, deviation = _moments(a, v, every)
    _, mean_n, deviation_n = _moments(a, n.astype(float), every)
    q50, q90, q95 = a.quantiles(v, every, ones, [0.5, 0.9, 0.95])
    # The largest sizes of a key, in falling order.
    falling = np.lexsort((-size, of))
    end = np.cumsum(active)
    top = [np.where(active > i, size[falling[np.minimum(end - active + i, len(x) - 1)]] if len(x) else 0.0, 0.0) for i in range(3)]
    # The day before, the day after and the value some days earlier.
    code = of * (1 << 32) + d + (1 << 31)
    same = (np.diff(of) == 0) & dated[1:] & dated[:-1]
    gap, gapped = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
    gap[1:], gapped[1:] = np.diff(d), same
    begins = ~(gapped & (gap == 1))
    run = a.max(np.arange(len(x)) - np.maximum.accumulate(np.where(begins, np.arange(len(x)), 0)) + 1.0, dated)
    alone = np.ones(len(x), dtype=bool)
    alone[:-1] = ~same | (gap[1:] > 1)

    def earlier(days: int) -> np.ndarray:
        spot = np.minimum(np.searchsorted(code, code - days), max(len(code) - 1, 0))
        return np.where(dated & (code[spot] == code - days) & dated[spot], x[spot], 0.0) if len(code) else x

    own_lo, own_hi, calendar = lo[of], hi[of], hi - lo + 1
    step = np.where(alone & dated & (d < own_hi), size, 0.0) + np.where(dated & (d > own_lo), np.abs(x - earlier(1)), 0.0)
    total_of = size if absolute else x
    gaps, mean_gap, gap_deviation = _moments(a, gap, gapped)
    middle_gap, = a.quantiles(gap, gapped, ones, [0.5])
    day = d.astype("datetime64[D]")
    month = day.astype("datetime64[M]")
    monthday = (day - month.astype("datetime64[D]")).astype(np.int64) + 1
    last = ((month + 1).astype("datetime64[D]") - month.astype("datetime64[D]")).astype(np.int64)
    weekday = (d + 3) % 7
    days_of = a.sum(dated.astype(np.int64))
    dated_share = lambda cond: (a.sum(np.where(dated & cond, 1.0, 0.0)) / days_of, days_of > 0)
    weekdays = a.counts(np.where(dated, weekday, -1), ones, len(T.WEEKDAYS))
    monthdays = a.counts(np.where(dated, monthday - 1, -1), ones, len(T.MONTH_DAYS))
    top_share = lambda counts: (counts.max(1) / counts.sum(1), counts.sum(1) > 0)
    limit = v >= q95[of] if absolute else v > q95[of]
    out = {
        "_found": (k.max(found.astype(float), told), k.sum(told.astype(np.int64)) > 0), "row_count": (k.sum(k.values("_n")[0]), always), "active_days": (active, always),
        "total_amount": (amount, some), "total_abs_amount": (abs_amount, some), f"mean_{stem}_amount": (mean, some), f"max_{stem}_amount": (a.max(v, every), some),
        "cv2": ((deviation / mean) ** 2, (active > 1) & (np.abs(mean) >= 1e-12)),
        "weekend_active_share": dated_share(weekday >= 5), "month_start_active_share": dated_share(monthday <= 5), "month_end_active_share": dated_share(monthday >= last - 4),
        "rows_per_active_day_mean": (mean_n, some), "rows_per_active_day_max": (a.max(n.astype(float), every), some),
        "rows_per_active_day_cv2": ((deviation_n / mean_n) ** 2, (active > 1) & (np.abs(mean_n) >= 1e-12)),
        "median_gap_days": (middle_gap, gaps > 0), "mean_gap_days": (mean_gap, gaps > 0), "cv_gap_days": (gap_deviation / mean_gap, (gaps > 1) & (mean_gap != 0)),
        "min_gap_days": (a.min(gap, gapped), gaps > 0), "max_gap_days": (a.max(gap, gapped), gaps > 0),
        "lead_days_mean": (k.sum(lead * times) / rows, rows > 0), "lead_days_median": (middle_lead, rows > 0),
        "known_at_least_d1_share": part(lead >= 1), "known_same_day_share": part(lead == 0),
        "_q50": (q50, some), "_q90": (q90, some), "_q95": (q95, some), "_top1": (top[0], some), "_top3": (top[0] + top[1] + top[2], some),
        "_spikes": (a.sum(limit.astype(float)), some), "_dow_entropy": (entropy(weekdays), some), "_dow_top": top_share(weekdays),
        "_dom_entropy": (entropy(monthdays), some), "_dom_top": top_share(monthdays), "_diff": (a.sum(step), some), "_total_of": (a.sum(total_of), some),
        "_run": (run, days_of > 0), "_gap": (a.max(gap, gapped) - 1, gaps > 0), "_first": (a.min(d.astype(float), dated), days_of > 0), "_last": (a.max(d.astype(float), dated), days_of > 0),
    }
    for recent in RECENT_DAYS:
        out[f"_recent_{recent}"] = (a.sum(np.where(dated & (d >= own_hi - (recent - 1)), total_of, 0.0)), some)
    for days in AUTO_LAGS:
        m = calendar - days
        left, right = np.where(dated & (d <= own_hi - days), x, 0.0), np.where(dated & (d >= own_lo + days), x, 0.0)
        sl, sr = a.sum(left) / m, a.sum(right) / m
        vl, vr = a.sum(left * left) / m - sl * sl, a.sum(right * right) / m - sr * sr
        usable = some & ended[k.first] & (m > 0) & (vl > 1e-18) & (vr > 1e-18)
        out[f"autocorr_lag_{days}"] = ((a.sum(x * earlier(days)) / m - sl * sr) / np.sqrt(vl * vr), usable)
    return out


def company_profile(tx: DataFrame, low: Column, high: Column, keys=("company_key",), absolute: bool = False, one_row_per_id: bool = False) -> DataFrame:
    """Activity, size, timing, recency and lead features per key.

    ``absolute`` takes sizes of absolute daily amounts and counts spikes from the 95 % value on;
    the signed form counts only days above it. ``one_row_per_id`` says that no ID has two rows, as in a cleaned
    extract: then IDs need no distinct count.
    """
    keys = list(keys)
    stem = "active_abs_daily" if absolute else "active_daily"
    lines = profile_days(tx, keys, low, high, one_row_per_id)
    kinds = ", ".join(f"{c} {kind}" for c, kind in _profile_columns(stem).items())
    schema = StructType([*lines.select(*keys).schema.fields, *StructType.fromDDL(kinds).fields])
    out = per_key(lines, keys, ["_d"], schema, lambda k: _profile_measures(k, absolute, stem))
    if not one_row_per_id:
        out = attach(out.drop("row_count"), tx.groupBy(*keys).agg(F.countDistinct("ID").alias("row_count")), keys)
    measured = [c for c in out.columns if c not in (*keys, "_found", "row_count")]
    out = out.select(*keys, F.col("_found").cast("boolean").alias("company_found"), "row_count", *measured).withColumns({"_lo": low, "_hi": high})
    low, high = F.col("_lo"), F.col("_hi")
    days = F.datediff(high, low) + 1
    zero_if_none = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0.0))
    adays = F.col("active_days")
    share = lambda c: F.when(F.col("total_abs_amount") > 0, c / F.col("total_abs_amount")).otherwise(0.0)
    edges = F.greatest(F.coalesce(F.col("_gap").cast("int"), F.lit(0)), F.datediff(F.col("_first"), low), F.datediff(high, F.col("_last")))
    columns = {
        "active_days": adays,
        "calendar_days": days,
        "total_amount": zero_if_none("total_amount"),
        "total_abs_amount": zero_if_none("total_abs_amount"),
        "mean_calendar_daily_amount": zero_if_none("total_amount") / days,
        f"mean_{stem}_amount": zero_if_none(f"mean_{stem}_amount"),
        f"median_{stem}_amount": zero_if_none("_q50"),
        f"q90_{stem}_amount": zero_if_none("_q90"),
        f"q95_{stem}_amount": zero_if_none("_q95"),
        f"max_{stem}_amount": zero_if_none(f"max_{stem}_amount"),
        "max_day_abs_share": share(F.col("_top1")),
        "top3_day_abs_share": share(F.col("_top3")),
        "active_rate": adays / days,
        "zero_rate": 1.0 - adays / days,
        "adi": F.when(adays > 0, days / adays),
        "longest_active_run": F.coalesce(F.col("_run").cast("int"), F.lit(0)),
        "longest_zero_run": F.when(adays > 0, edges).otherwise(days),
        "weekday_entropy": zero_if_none("_dow_entropy"),
        "weekday_top_share": F.col("_dow_top"),
        "dayofmonth_entropy": zero_if_none("_dom_entropy"),
        "dayofmonth_top_share": F.col("_dom_top"),
        "mean_abs_daily_diff": F.when(days > 1, zero_if_none("_diff") / (days - 1)).otherwise(0.0),
        "spike_active_share": F.when(adays > 0, F.col("_spikes") / adays).otherwise(0.0),
    }
    columns |= {c: zero_if_none(c) for c in ("weekend_active_share", "month_start_active_share", "month_end_active_share",
                                             "rows_per_active_day_mean", "rows_per_active_day_max")}
    columns |= {
        f"recent_{n}_amount_share": F.when(F.abs("_total_of") >= 1e-12, F.col(f"_recent_{n}") / F.col("_total_of")).otherwise(0.0)
        for n in RECENT_DAYS
    }
    out = out.withColumns(columns).withColumn("sbc_label", sbc_label("adi", "cv2"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def company_history(tx: DataFrame, low: Column, high: Column, one_row_per_id: bool = False) -> DataFrame:
    """Compact profile per company for row features."""
    p = company_profile(tx, low, high, absolute=True, one_row_per_id=one_row_per_id)
    return p.select(
        "company_key",
        F.col("row_count").alias("company_row_count"),
        F.col("active_days").alias("company_active_days"),
        F.col("total_abs_amount").alias("company_total_abs_amount"),
        F.col("active_rate").alias("company_active_rate"),
        F.col("adi").alias("company_adi"),
        F.col("cv2").alias("company_cv2"),
        F.col("sbc_label").alias("company_sbc_label"),
        F.col("q90_active_abs_daily_amount").alias("company_q90_abs_daily_amount"),
        F.col("max_active_abs_daily_amount").alias("company_max_abs_daily_amount"),
        F.col("max_day_abs_share").alias("company_max_day_abs_share"),
    )


def transaction_features(tx: DataFrame, low: Column, high: Column, one_row_per_id: bool = False, layers: Layers | None = None,
                         count_rows: bool = False) -> DataFrame:
    """Row features: size, calendar position, lead, same-day company totals and company history.

    ``one_row_per_id``: see ``company_profile``. ``count_rows``, for such rows, counts the rows of a day in place of its
    IDs; amounts are then added in another order, which can change their last bit. With ``layers`` the day totals, the rows with them and the history are
    written one after the other, so that the shuffle files of one go before the next.
    """
    keys = ["company_key", VALUE]
    ids = F.count("ID") if one_row_per_id and count_rows else F.countDistinct("ID")
    day = tx.groupBy(*keys).agg(
        F.sum("amount").alias("company_day_amount"),
        F.sum(F.abs("amount")).alias("company_day_abs_amount"),
        ids.alias("company_day_row_count"),
    )
    history = lambda: company_history(tx, low, high, one_row_per_id)
    if layers is None:
        out = attach(attach(tx, day, keys), history(), ["company_key"])
    else:
        rows = layers.get("feature-rows", lambda: attach(tx, layers.get("feature-days", lambda: day), keys))
        layers.drop("feature-days")
        out = attach(rows, layers.get("feature-history", history), ["company_key"])
    lead = F.datediff(VALUE, TRADE).cast("double")
    return out.withColumns(
        {
            "log_abs_amount": F.log1p(F.abs("amount")),
            "dayofweek": F.weekday(VALUE),
            "dayofmonth": F.day(VALUE),
            "is_weekend": (F.weekday(VALUE) >= 5).cast("int"),
            "is_month_start": (F.day(VALUE) == 1).cast("int"),
            "is_month_end": (F.col(VALUE) == F.last_day(VALUE)).cast("int"),
            "days_since_start": F.datediff(F.col(VALUE), low).cast("double"),
            "days_to_end": F.datediff(high, F.col(VALUE)).cast("double"),
            "lead_days": lead,
            "known_at_least_d1": F.coalesce((lead >= 1).cast("double"), F.lit(0.0)),
            "known_same_day": F.coalesce((lead == 0).cast("double"), F.lit(0.0)),
        }
    )


# --- event profiles, behaviour and selection ------------------------------------------------


def event_profile(tx: DataFrame, keys, quantiles: dict[str, float], amount: str = "abs_amount",
                  positive_days: bool = True, layers: Layers | None = None) -> DataFrame:
    """Payment-level and day-level measures per key, no calendar needed.

    The rows are summed per (key, day) once and everything but the row quantiles follows from the days,
    so no distinct counts over rows are needed. The days of a key, bounded by the calendar, are ordered once.
    ``positive_days``: day measures skip days without amount. With ``layers`` the measures of the days are written before
    the quantiles are taken, so that the shuffle files of both never lie on disk together; the profile is to be written
    before another is taken with the same layers.
    """
    keys = list(keys)
    a = F.col(amount)
    daily = tx.groupBy(*keys, VALUE).agg(
        F.count("*").alias("_n"), F.count(a).alias("_na"), F.sum(a).alias("_y"), F.sum("amount").alias("_t"), F.sum(a * a).alias("_s"), F.max(a).alias("_m"))
    derived = {
        "_d": F.unix_date(VALUE), "_dow": F.coalesce(F.weekday(VALUE), F.lit(-1)), "_dom": F.coalesce(F.day(VALUE), F.lit(0)) - 1,
        "_end": F.coalesce(month_end(VALUE), F.lit(False)).cast("int"), "_start": F.coalesce(month_start(VALUE), F.lit(False)).cast("int"),
        **{c: F.col(c).cast("double") for c in ("_y", "_t", "_s", "_m")},
    }
    kinds = ", ".join(f"{c} {kind}" for c, kind in _EVENT_COLUMNS.items())
    schema = StructType([*daily.select(*keys).schema.fields, *StructType.fromDDL(kinds).fields])
    measured = lambda days: per_key(days, keys, ["_d"], schema, lambda k: _event_measures(k, positive_days), derived)
    if layers is None:
        base = measured(daily)
    else:
        layers.drop(*PROFILE_STEPS)
        base = layers.get("profile-measures", lambda: measured(layers.get("profile-days", lambda: daily)))
        layers.drop("profile-days")
    out = attach(base, exact_quantiles(tx, amount, quantiles, keys), keys)
    return out.withColumn("span_days", F.datediff("last_date", "first_date") + 1)


# Layers that only an event profile reads while it is written.
PROFILE_STEPS = ("profile-days", "profile-measures")

# Columns of an event profile that follow from the days of a key.
_EVENT_COLUMNS = {
    "n_rows": "bigint", "n_active_days": "bigint", "total_amount": "double", "total_abs_amount": "double", "mean_abs_amount": "double",
    "max_abs_amount": "double", "first_date": "date", "last_date": "date", "month_end_share": "double", "month_start_share": "double",
    "payment_abs_hhi": "double", "mean_daily_abs_amount": "double", "median_daily_abs_amount": "double", "std_daily_abs_amount": "double",
    "max_daily_abs_amount": "double", "cv2_daily_abs_amount": "double", "median_gap_days": "double", "mean_gap_days": "double",
    "cv_gap_days": "double", "min_gap_days": "double", "max_gap_days": "double", "dow_entropy": "double", "dow_top_share": "double",
    "dom_entropy": "double", "dom_top_share": "double",
}


def _moments(k: Keyed, x: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and sample deviation by key."""
    n = k.sum(used.astype(np.int64))
    mean = k.sum(np.where(used, x, 0.0)) / n
    off = np.where(used, x - mean[k.of_row], 0.0)
    return n, mean, np.sqrt(k.sum(off * off) / (n - 1))


def _event_measures(k: Keyed, positive_days: bool) -> dict:
    """The columns of an event profile, each with the keys that have a value; the days of a key are in order."""
    n, na, y, t, s, m = (k.values(c) for c in ("_n", "_na", "_y", "_t", "_s", "_m"))
    (day, dated), (dow, _), (dom, _), (end, _), (start, _) = (k.values(c) for c in ("_d", "_dow", "_dom", "_end", "_start"))
    ones, always = np.ones(len(day), dtype=np.int64), np.ones(k.n, dtype=bool)
    rows = k.sum(n[0])
    some = lambda used: k.sum(used.astype(np.int64)) > 0
    total, has_total = k.sum(y[0]), some(y[1])
    rated = y[1] & ((y[0] > 0) | np.isnan(y[0])) if positive_days else y[1]
    count, mean, deviation = _moments(k, y[0], rated)
    middle, = k.quantiles(y[0], rated, ones, [0.5])
    # Gaps between the days that count; a key's first such day has none.
    at = np.flatnonzero(dated & rated if positive_days else dated)
    gap, gapped = np.zeros(len(day)), np.zeros(len(day), dtype=bool)
    gap[at[1:]], gapped[at[1:]] = np.diff(day[at]), np.diff(k.of_row[at]) == 0
    gaps, mean_gap, gap_deviation = _moments(k, gap, gapped)
    middle_gap, = k.quantiles(gap, gapped, ones, [0.5])
    weekdays, monthdays = k.counts(dow, n[0], len(T.WEEKDAYS)), k.counts(dom, n[0], len(T.MONTH_DAYS))
    top = lambda c: (c.max(1) / c.sum(1), c.sum(1) > 0)
    return {
        "n_rows": (rows, always), "n_active_days": (k.sum(dated.astype(np.int64)), always),
        "total_amount": (k.sum(t[0]), some(t[1])), "total_abs_amount": (total, has_total),
        "mean_abs_amount": (total / k.sum(na[0]), has_total), "max_abs_amount": (k.max(*m), some(m[1])),
        "first_date": (k.min(day, dated), some(dated)), "last_date": (k.max(day, dated), some(dated)),
        "month_end_share": (k.sum(end * n[0]) / rows, always), "month_start_share": (k.sum(start * n[0]) / rows, always),
        "payment_abs_hhi": (k.sum(s[0]) / total**2, has_total & (total != 0)),
        "mean_daily_abs_amount": (mean, count > 0), "median_daily_abs_amount": (middle, count > 0),
        "std_daily_abs_amount": (deviation, count > 1), "max_daily_abs_amount": (k.max(y[0], rated), count > 0),
        "cv2_daily_abs_amount": ((deviation / mean) ** 2, (count > 1) & (np.abs(mean) >= 1e-12)),
        "median_gap_days": (middle_gap, gaps > 0), "mean_gap_days": (mean_gap, gaps > 0), "cv_gap_days": (gap_deviation / mean_gap, (gaps > 1) & (mean_gap != 0)),
        "min_gap_days": (k.min(gap, gapped), gaps > 0), "max_gap_days": (k.max(gap, gapped), gaps > 0),
        "dow_entropy": (entropy(weekdays), always), "dow_top_share": top(weekdays), "dom_entropy": (entropy(monthdays), always), "dom_top_share": top(monthdays),
    }


def _schedule(active: str, gap: tuple[int, int], spread: float, minimum: int, top: str) -> Column:
    regular = F.col("median_gap_days").between(*gap) & (F.col("cv_gap_days").isNull() | (F.col("cv_gap_days") <= spread))
    return (F.col(active) >= minimum) & (F.coalesce(regular, F.lit(False)) | F.coalesce(F.col(top) >= 0.60, F.lit(False)))


def behavior_class(variant: str = "company", spike: str = "max_to_median_abs") -> Column:
    """Ordered behaviour rules; the ``regime`` variant tests rare events and months first."""
    n, active, total = F.col("n_rows"), F.col("n_active_days"), F.col("total_abs_amount")
    cv2 = F.coalesce(F.col("cv2_daily_abs_amount"), F.lit(math.inf))
    spiky = F.coalesce(F.col(spike) >= 10, F.lit(False))
    weekly = (_schedule("n_active_days", (6, 8), 0.45, 8, "dow_top_share"), "periodic_weekly")
    monthly = (_schedule("n_active_days", (25, 35), 0.35, 4, "dom_top_share"), "periodic_monthly")
    if variant == "company":
        rules = [
            weekly, monthly,
            ((n <= 3) & (total >= 100_000), "rare_large"),
            ((active >= 30) & (cv2 <= 1.0), "frequent_stable"),
            (active >= 30, "frequent_erratic"),
            ((active >= 6) & (cv2 <= 0.49), "intermittent_stable"),
            ((active >= 6) & spiky, "lumpy_spiky"),
            (active >= 6, "intermittent_lumpy"),
        ]
    elif variant == "regime":
        rules = [
            (F.col("company_clean") == NO_COMPANY, "no_company"),
            (n <= 2, "one_or_two_spikes"),
            ((n <= 5) & (total >= 100_000), "rare_large"),
            monthly, weekly,
            ((active >= 30) & (cv2 <= 1.0), "frequent_stable"),
            (active >= 30, "frequent_erratic"),
            ((active >= 6) & (cv2 <= 0.49), "intermittent_stable_amount"),
            ((active >= 6) & spiky, "lumpy_spiky"),
            (active >= 6, "lumpy_intermittent"),
        ]
    else:
        raise ValueError(f"unknown variant: {variant}")
    return ladder(rules, "sparse_tail")


# Behaviours that earn the regularity bonus, and the weights of the score.
REGULAR = ("periodic_weekly", "periodic_monthly", "frequent_stable")
SCORE_WEIGHTS = {"rank_amount_pct": 0.45, "rank_rows_pct": 0.25, "rank_active_days_pct": 0.15,
                 "recency_score": 0.10, "regularity_bonus": 0.05}


def selection_score(profile: DataFrame, behavior: str, keys=()) -> DataFrame:
    """Weighted average-tie percent ranks, recency and regularity as ``score``."""
    keys = list(keys)
    # The profile has one row per company and is read several times: hand in a written layer.
    profile = profile.withColumn("_amount", F.round("total_abs_amount", 6))
    names = {"_amount": "rank_amount_pct", "n_rows": "rank_rows_pct", "n_active_days": "rank_active_days_pct"}
    ranked = percent_ranks(profile, names, keys)
    longest = F.greatest(profile.agg(F.max("days_since_last").cast("double")).scalar(), F.lit(1.0))
    ranked = ranked.drop("_amount").withColumns(
        {
            "recency_score": 1.0 - F.greatest(F.col("days_since_last"), F.lit(0)) / longest,
            "regularity_bonus": F.col(behavior).isin(*REGULAR).cast("double"),
        }
    )
    score = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        score = score + weight * F.coalesce(F.col(name), F.lit(0.0))
    return ranked.withColumn("score", F.round(score, 12))


def company_profile_events(tx: DataFrame, layers: Layers | None = None) -> DataFrame:
    """Profile of named companies with behaviour, shares and score inputs; ``layers``: see ``event_profile``."""
    known = tx.filter("company_found")
    end = tx.agg(F.max(VALUE)).scalar()
    p = event_profile(known, ["company_name"], {"median_abs_amount": 0.5, "p90_abs_amount": 0.9}, positive_days=False, layers=layers)
    p = p.withColumns(
        {
            "days_since_last": F.datediff(end, F.col("last_date")),
            "max_to_median_abs": F.when(F.col("median_abs_amount") != 0, F.col("max_abs_amount") / F.col("median_abs_amount")),
        }
    )
    p = p.withColumn("behavior_group", behavior_class())
    total = known.agg(F.sum("abs_amount")).scalar()
    return p.withColumn("share_total_abs", F.when(total != 0, F.col("total_abs_amount") / total))


def select_companies(profile: DataFrame, budget: int = 30, min_rows: int = 5, min_days: int = 3, min_total: float = 100_000.0,
                     force=(), exclude=()) -> DataFrame:
    """Score, eligibility and the budgeted selection with its reason."""
    scored = selection_score(profile, "behavior_group").withColumnRenamed("score", "company_score")
    eligible = (F.col("n_rows") >= min_rows) & (F.col("n_active_days") >= min_days) & (F.col("total_abs_amount") >= min_total)
    order = [F.desc("company_score"), F.desc("total_abs_amount"), F.desc("n_rows"), F.asc("company_name")]
    chosen = scored.filter(eligible).orderBy(*order).limit(budget).select("company_name", F.lit(True).alias("_auto"))
    out = attach(scored, chosen, ["company_name"])
    auto, forced, banned = F.coalesce("_auto", F.lit(False)), F.col("company_name").isin(*force), F.col("company_name").isin(*exclude)
    return out.withColumns(
        {
            "auto_selected": auto,
            "is_selected_company": (auto | forced) & ~banned,
            "selection_reason": ladder([(forced, "force_selected"), (banned, "force_excluded"), (auto, "auto_score")], "not_selected"),
        }
    ).drop("_auto")


# --- regimes -------------------------------------------------------------------------------

# Bins of company totals, of payment counts and of row amounts per regime.
VALUE_BINS = ((None, 1_000, "total_lt_1k"), (1_000, 100_000, "total_1k_100k"), (100_000, 5_000_000, "total_100k_5M"),
              (5_000_000, 100_000_000, "total_5M_100M"), (100_000_000, None, "total_100M_plus"))
FREQUENCY_BINS = ((2, "freq_1_2"), (5, "freq_3_5"), (20, "freq_6_20"), (50, "freq_21_50"), (500, "freq_51_500"))
UNDER_ROW_EDGES = (0, 1_000, 5_000, 20_000, 100_000)
OVER_ROW_EDGES = (100_000, 500_000, 1_000_000, 5_000_000)
UNDER, OVER = "under_100k", "over_100k"


def value_bin(total: Column | str) -> Column:
    return bin_label(total, [(low if low is not None else -math.inf, high, label) for low, high, label in VALUE_BINS])


def frequency_bin(n: Column | str) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return ladder([(c <= top, label) for top, label in FREQUENCY_BINS], "freq_500_plus")


def row_amount_bin(size: Column | str, regime: Column | str) -> Column:
    x = F.col(size) if isinstance(size, str) else size
    r = F.col(regime) if isinstance(regime, str) else regime
    under = [(lo, hi, f"row_{lo}_{hi}") for lo, hi in zip(UNDER_ROW_EDGES, UNDER_ROW_EDGES[1:])]
    over = [(lo, hi, f"row_{lo}_{hi}") for lo, hi in zip(OVER_ROW_EDGES, OVER_ROW_EDGES[1:])]
    top = f"row_{OVER_ROW_EDGES[-1]}_plus"
    # A value outside every bin takes the last label of its regime.
    return F.when(r == UNDER, bin_label(x, under, under[-1][2])).otherwise(bin_label(x, over, top))


def prepare_transactions(df: DataFrame, day: str = VALUE, company: str = "company_name", amount: str = "amount",
                         found: str = "company_found", threshold: float = 100_000.0, on_abs: bool = True) -> DataFrame:
    """Typed rows with regime, row bin, company bucket and calendar flags."""
    rows = df.withColumns({day: F.col(day).cast("date"), "amount": F.col(amount).try_cast("double")})
    rows = rows.filter(F.col(day).isNotNull() & F.col("amount").isNotNull())
    rows = rows.withColumn("_clean", F.coalesce(simple_company_name(company), F.lit("")))  # once a row, used twice
    clean = F.col("_clean")
    has = F.coalesce(F.col(found), F.lit(False)) if found in df.columns else clean != ""
    basis = F.abs("amount") if on_abs else F.col("amount")
    rows = rows.withColumns(
        {
            "company_found_clean": has,
            "company_clean": F.when(has & (clean != ""), clean).otherwise(NO_COMPANY),
            "abs_amount": F.abs("amount"),
            "amount_regime": F.when(basis >= threshold, OVER).otherwise(UNDER),
            "dayofweek": F.weekday(day),
            "dayofmonth": F.day(day),
            "is_month_end_window": month_end(day),
            "is_month_start_window": month_start(day),
        }
    )
    return rows.withColumn("row_amount_bin", row_amount_bin("abs_amount", "amount_regime")).drop("_clean")


REGIME_KEYS = ["amount_regime", "company_clean"]


def regime_profile(tx: DataFrame, layers: Layers | None = None) -> DataFrame:
    """Event profile per regime and company with bins, shares and behaviour; ``layers``: see ``event_profile``."""
    p = event_profile(tx, REGIME_KEYS, {"median_abs_amount": 0.5, "p90_abs_amount": 0.9, "p99_abs_amount": 0.99}, layers=layers)
    ends = tx.agg(F.struct(F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi")).alias("b")).scalar()
    history = F.datediff(ends["hi"], ends["lo"]) + 1
    p = p.withColumns(
        {
            "history_days": history,
            "adi": history / F.col("n_active_days"),
            "days_since_last": F.datediff(ends["hi"], F.col("last_date")),
            "max_to_median_abs": F.when(F.col("median_abs_amount") != 0, F.col("max_abs_amount") / F.col("median_abs_amount")),
            "freq_bin": frequency_bin("n_rows"),
            "value_bin": value_bin("total_abs_amount"),
        }
    ).withColumn("sbc_label", sbc_label("adi", "cv2_daily_abs_amount"))
    p = p.withColumn("behavior_label", behavior_class("regime"))
    split = tx.groupBy("amount_regime").agg(F.sum("abs_amount").alias("_s"))  # two regimes
    total = tx.agg(F.sum("abs_amount")).scalar()
    p = attach(p, split, ["amount_regime"])
    ratio = lambda d: F.when(d != 0, F.col("total_abs_amount") / d)
    return p.withColumns({"share_total_abs": ratio(total), "share_split_abs": ratio(F.col("_s"))}).drop("_s")


# Per regime the budget and the least payments, days and total of an own series.
OWN_LIMITS = {UNDER: (60, 20, 10, 500_000.0), OVER: (40, 3, 2, 500_000.0)}


def select_own_series(profile: DataFrame, limits=None, allow_rare: bool = False) -> DataFrame:
    """Own-series decision per regime: eligibility, budget by score, and the reason."""
    limits = limits or OWN_LIMITS
    f = selection_score(profile, "behavior_label", ["amount_regime"]).withColumnRenamed("score", "own_score")
    named = F.col("company_clean") != NO_COMPANY
    rare = (F.col("n_rows") <= 2) & F.lit(not allow_rare)
    enough = F.lit(False)
    for regime, (_, payments, days, total) in limits.items():
        big = (F.col("n_rows") >= payments) | (F.col("total_abs_amount") >= total)
        enough = enough | ((F.col("amount_regime") == regime) & big & (F.col("n_active_days") >= days))
    f = f.withColumn("own_eligible", named & ~rare & enough)
    order = [F.desc("own_score"), F.desc("total_abs_amount"), F.desc("n_rows"), F.asc("company_clean")]
    picked = None
    for regime, (budget, *_) in limits.items():
        part = f.filter(F.col("own_eligible") & (F.col("amount_regime") == regime)).orderBy(*order).limit(budget)
        part = part.select(*REGIME_KEYS, F.lit(True).alias("_own"))
        picked = part if picked is None else picked.unionByName(part)
    f = attach(f, picked, REGIME_KEYS).withColumn("is_own_series", F.coalesce("_own", F.lit(False))).drop("_own")
    reason = ladder(
        [
            (~named, "no_company_bucket"),
            (rare, "one_or_two_spikes_grouped_not_own"),
            (F.col("is_own_series"), "selected_by_hybrid_occurrence_value_score"),
            (F.col("own_eligible"), "eligible_but_outside_series_budget"),
        ],
        "",
    )
    return f.withColumn("own_reason", reason)
