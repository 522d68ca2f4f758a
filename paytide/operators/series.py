"""Daily series from counterparties: bands, manual picks, rules, tails and their checks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import AMOUNT_BINS, ladder
from ..functions.text import NO_COMPANY, sanitize_label, simple_company_name
from .companies import (
    PROFILE_STEPS,
    REGIME_KEYS,
    prepare_transactions,
    regime_profile,
    select_own_series,
)
from .gold import VALUE
from .quantiles import attach, exact_quantiles, weighted_quantiles
from ..sources.layers import Layers
from .relational import densify, string_sample, wide_table

INF = float("inf")


# --- amount bands --------------------------------------------------------------------------


@dataclass(frozen=True)
class Bands:
    """Contiguous half-open bands of the absolute amount."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.edges) != len(self.labels) + 1 or len(set(self.labels)) != len(self.labels):
            raise ValueError("bands need one unique label per interval")
        if any(a >= b for a, b in zip(self.edges, self.edges[1:])):
            raise ValueError("band edges must rise")

    def rows(self) -> list[tuple[str, int, float, float, str]]:
        return [
            (label, i, lo, hi, f"[{lo:,.0f}, {'inf' if hi == INF else format(hi, ',.0f')})")
            for i, (label, lo, hi) in enumerate(zip(self.labels, self.edges, self.edges[1:]))
        ]


# The default bands.
DEFAULT_BANDS = Bands((0.0, 20_000.0, 100_000.0, 500_000.0, 1_000_000.0, INF), ("tiny", "low", "mid", "large", "mega"))


def add_band_columns(tx: DataFrame, bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """Band label, order and display text; a row outside all bands is an error."""
    size = F.abs(F.col("amount"))
    inside = lambda lo, hi: (size >= lo) & (size < hi if hi != INF else size < F.lit(INF))
    pick = lambda i: ladder(
        [(inside(lo, hi), row[i]) for row in bands.rows() for lo, hi in [(row[2], row[3])]],
        F.raise_error(F.lit("amount outside all bands")).cast("int" if i == 1 else "string"),
    )
    return tx.withColumns(
        {"amount_abs": size, "amount_band": pick(0), "amount_band_order": pick(1), "amount_band_display": pick(4)}
    )


def band_summary(tx: DataFrame, calendar_days: Column) -> DataFrame:
    keys = ["amount_band", "amount_band_order", "amount_band_display"]
    base = tx.groupBy(*keys).agg(
        F.countDistinct("ID").alias("row_count"),
        F.countDistinct("company_key").alias("company_count"),
        F.countDistinct(VALUE).alias("active_days"),
        F.sum("amount").alias("total_amount"),
        F.sum("amount_abs").alias("total_abs_amount"),
        F.max("amount_abs").alias("max_row_abs_amount"),
    )
    quantiles = exact_quantiles(tx, "amount_abs", {"q50_row_abs_amount": 0.5, "q90_row_abs_amount": 0.9}, keys)
    return attach(base, quantiles, keys).withColumn("zero_rate", 1.0 - F.col("active_days") / calendar_days)


# Quantile points of the threshold table.
THRESHOLD_POINTS = (0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)


def amount_quantiles(tx: DataFrame, points=THRESHOLD_POINTS) -> DataFrame:
    names = {f"q{i}": p for i, p in enumerate(points)}
    wide = exact_quantiles(tx, "amount_abs", names)
    pairs = F.array(*[F.struct(F.lit(p).alias("quantile"), F.col(n).alias("amount_abs")) for n, p in names.items()])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def band_threshold_candidates(tx: DataFrame, bands: Bands = DEFAULT_BANDS) -> DataFrame:
    """Edges of each proposal: current, equal-frequency, log-spaced p01..p99 and amount-weighted."""
    n = len(bands.labels)
    inner = [i / n for i in range(1, n)]
    inf = F.lit(INF)
    equal = exact_quantiles(tx, "amount_abs", {f"e{i}": p for i, p in enumerate(inner)})
    positive = exact_quantiles(tx.filter("amount_abs > 0"), "amount_abs", {"lo": 0.01, "hi": 0.99})
    start = F.greatest(F.col("lo"), F.lit(1.0))
    stop = F.greatest(F.col("hi"), start)
    steps = max(n - 2, 1)
    spaced = [F.exp(F.log(start) + (F.log(stop) - F.log(start)) * (i / steps)) for i in range(n - 1)]
    weighted = weighted_quantiles(tx, "amount_abs", F.col("amount_abs"), inner)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("PROBABILITY", "VALUE"))), lambda p: p["VALUE"])
    proposals = [
        tx.sparkSession.range(1).select(F.lit("current_hardcoded").alias("method"), F.array(*[F.lit(e) for e in bands.edges]).alias("e")),
        equal.select(F.lit("equal_frequency").alias("method"), F.array(F.lit(0.0), *[F.col(f"e{i}") for i in range(n - 1)], inf).alias("e")),
        positive.select(F.lit("log_spaced_p01_p99").alias("method"), F.array(F.lit(0.0), *spaced, inf).alias("e")),
        weighted.agg(in_order.alias("m")).select(F.lit("weighted_by_abs_amount").alias("method"), F.concat(F.array(F.lit(0.0)), "m", F.array(inf)).alias("e")),
    ]
    out = proposals[0]
    for p in proposals[1:]:
        out = out.unionByName(p)
    labels = F.array(*[F.lit(label) for label in bands.labels])
    rows = out.select("method", "e", F.posexplode(labels).alias("amount_band_order", "amount_band"))
    return rows.select("method", "amount_band", "amount_band_order", F.get("e", F.col("amount_band_order")).alias("low"),
                       F.get("e", F.col("amount_band_order") + 1).alias("high"))


# --- manual membership ---------------------------------------------------------------------


@dataclass(frozen=True)
class SeriesSpec:
    """One company, payments in [low, high), kept on days whose selected total is in [daily_low, daily_high)."""

    series_id: str
    company: str
    payment_low: float = 0.0
    payment_high: float = INF
    daily_low: float = 0.0
    daily_high: float = INF

    def __post_init__(self):
        if self.payment_low >= self.payment_high or self.daily_low >= self.daily_high:
            raise ValueError(f"{self.series_id}: lower bound must be below upper bound")


def manual_membership(tx: DataFrame, specs: list[SeriesSpec]) -> DataFrame:
    """Rows of the specified series; a row in two series is an error.

    The few specs become one list of matches per row, so the rows are read once. Daily totals are
    aggregated and joined back, which combines on the map side for a company with most rows.
    """
    matches = F.array(*[
        F.when(
            (F.col("company_name") == s.company) & (F.col("amount") >= s.payment_low) & (F.col("amount") < s.payment_high),
            F.struct(F.lit(s.series_id).alias("series_id"), F.lit(s.payment_low).alias("payment_bin_low"), F.lit(s.payment_high).alias("payment_bin_high"),
                     F.lit(s.daily_low).alias("daily_bin_low"), F.lit(s.daily_high).alias("daily_bin_high")),
        )
        for s in specs
    ])
    rows = tx.select("ID", "company_name", VALUE, "amount", F.explode(F.array_compact(matches)).alias("s"))
    rows = rows.select("ID", "company_name", VALUE, "amount", "s.*")
    totals = rows.groupBy("series_id", VALUE).agg(F.sum("amount").alias("selected_daily_amount"))
    kept = rows.join(totals, ["series_id", VALUE]).filter(
        (F.col("selected_daily_amount") >= F.col("daily_bin_low")) & (F.col("selected_daily_amount") < F.col("daily_bin_high"))
    )
    rest = [c for c in kept.columns if c != "ID"]
    once = F.when(F.count("*") > 1, F.raise_error(F.lit("series specs overlap on a row")))
    return kept.groupBy("ID").agg(once.otherwise(F.first(F.struct(*rest))).alias("r")).select("ID", "r.*")


def rows_for_series(tx: DataFrame, membership: DataFrame, series_id: str) -> DataFrame:
    return tx.join(membership.filter(F.col("series_id") == series_id).select("ID"), "ID", "left_semi")


def exclude_series(tx: DataFrame, membership: DataFrame, series_ids) -> DataFrame:
    return tx.join(membership.filter(F.col("series_id").isin(list(series_ids))).select("ID"), "ID", "left_anti")


def membership_summary(membership: DataFrame) -> DataFrame:
    return membership.groupBy("series_id").agg(
        F.countDistinct("ID").alias("row_count"), F.countDistinct(VALUE).alias("active_days"),
        F.sum("amount").alias("total_amount"), F.min(VALUE).alias("first_date"), F.max(VALUE).alias("last_date"),
    )


def dense_daily_series(rows: DataFrame, low: Column, high: Column, kind: str | None = None, key: str = "series_id") -> DataFrame:
    dense = densify(rows, key, "amount", low, high)
    return dense if kind is None else dense.withColumn("series_kind", F.lit(kind))


def daily_series_long(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Every day of every series with its amount, absolute amount and rows."""
    return densify(rows, "series_id", "amount", low, high, more={"abs_amount": F.sum("abs_amount"), "n_rows": F.count("*")})


def series_names(rows: DataFrame) -> list[str]:
    """The series of assigned rows in order: own ones within their budget, the others products of short label lists."""
    return sorted(r["series_id"] for r in rows.select("series_id").filter("series_id IS NOT NULL").distinct().collect())


def daily_series_wide(rows: DataFrame, key: str, names: list[str], low: Column, high: Column) -> DataFrame:
    from .gold import days_between

    days = days_between(rows.sparkSession, low, high, VALUE)
    return days.join(wide_table(rows, key, names, "amount"), VALUE, "left").fillna(0.0, names)


def band_total_series(membership: DataFrame, low: Column, high: Column, prefix: str, kind: str) -> DataFrame:
    """Dense daily total per amount band."""
    dense = densify(membership, "amount_band", "amount", low, high)
    order = membership.select("amount_band", "amount_band_order").distinct()
    return attach(dense, order, ["amount_band"]).withColumns(
        {"series_id": F.concat(F.lit(prefix + "_"), F.upper("amount_band"), F.lit("_TOTAL")), "series_kind": F.lit(kind)}
    )


def series_summary(membership: DataFrame, calendar_days: Column, label: str) -> DataFrame:
    """Activity and concentration per series.

    The dense daily table is not read back: absent days are zeros, and the 90 % point of a series
    with z zero days is taken from its sorted active values shifted by z.
    """
    key = ["series_id"]
    base = membership.groupBy(*key).agg(
        F.countDistinct("company_key").alias("company_count"), F.countDistinct("ID").alias("row_count"),
        F.sum("amount").alias("total_amount"), F.sum(F.abs("amount")).alias("total_abs_amount"),
        F.min(VALUE).alias("first_date"), F.max(VALUE).alias("last_date"),
        F.min_by("amount_band", "amount_band_order").alias("amount_band"), F.min("amount_band_order").alias("amount_band_order"),
    )
    daily = membership.groupBy(*key, VALUE).agg(F.abs(F.sum("amount")).alias("_a")).filter("_a <> 0")
    stats = daily.groupBy(*key).agg(
        F.count("*").alias("active_days"), F.max("_a").alias("max_daily_abs_amount"), F.sum("_a").alias("_t"),
        F.array_sort(F.collect_list("_a")).alias("_v"),  # at most one value per calendar day
    )
    top = membership.groupBy(*key, "company_key").agg(F.sum(F.abs("amount")).alias("_c")).groupBy(*key).agg(F.max("_c").alias("_top"))
    out = attach(attach(base, stats, key), top, key)
    n, zeros = calendar_days, calendar_days - F.col("active_days")
    position = 0.9 * (n - 1)
    at = lambda rank: F.when(rank < zeros, 0.0).otherwise(F.get("_v", (rank - zeros).cast("int")))
    low, high = at(F.floor(position)), at(F.ceil(position))
    share = lambda a, b: F.when(b != 0, a / b)
    return out.withColumns(
        {
            "active_days": F.coalesce("active_days", F.lit(0)),
            "zero_rate": 1.0 - F.coalesce("active_days", F.lit(0)) / n,
            "max_daily_abs_amount": F.coalesce("max_daily_abs_amount", F.lit(0.0)),
            "q90_abs_daily_amount": F.coalesce(low + (position - F.floor(position)) * (high - low), F.lit(0.0)),
            "max_day_abs_share": share(F.col("max_daily_abs_amount"), F.col("_t")),
            "top_company_share": share(F.col("_top"), F.col("total_abs_amount")),
            "strategy": F.lit(label),
        }
    ).drop("_t", "_v", "_top")


def series_company_detail(membership: DataFrame) -> DataFrame:
    return membership.groupBy("series_id", "amount_band", "amount_band_order", "company_key").agg(
        F.countDistinct("ID").alias("row_count"), F.countDistinct(VALUE).alias("active_days"), F.sum("amount").alias("total_amount"),
        F.sum(F.abs("amount")).alias("total_abs_amount"), F.min(VALUE).alias("first_date"), F.max(VALUE).alias("last_date"),
    )


# --- checks --------------------------------------------------------------------------------


def check_membership(membership: DataFrame, tx: DataFrame) -> DataFrame:
    """One row: source IDs without a series, series IDs without a source, IDs in several series."""
    tagged = tx.select("ID").distinct().select("ID", F.lit(1).alias("s"), F.lit(0).alias("m")).unionByName(
        membership.select("ID", F.lit(0).alias("s"), F.lit(1).alias("m"))
    )
    per_id = tagged.groupBy("ID").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    return per_id.agg(
        F.count_if((F.col("s") > 0) & (F.col("m") == 0)).alias("missing"),
        F.count_if((F.col("s") == 0) & (F.col("m") > 0)).alias("extra"),
        F.count_if(F.col("m") > 1).alias("duplicated"),
    )


def check_dense(dense: DataFrame, calendar_days: Column, key: str = "series_id") -> DataFrame:
    return dense.agg(F.count("*").alias("rows"), (F.countDistinct(key) * calendar_days).alias("expected_rows"))


def check_reconstruction(series: DataFrame, raw: DataFrame) -> DataFrame:
    """Largest daily difference between the sum of all series and the raw rows."""
    both = raw.select(VALUE, F.col("amount").alias("d")).unionByName(series.select(VALUE, (-F.col("amount")).alias("d")))
    daily = both.groupBy(VALUE).agg(F.sum("d").alias("d"))
    return daily.agg(F.max(F.abs("d")).alias("max_abs_reconstruction_error"), F.count("*").alias("days"))


# --- series by rules -----------------------------------------------------------------------

RULE_COLUMNS = ("priority", "enabled", "series_name", "rule_type", "company_name", "company_found", "amount_bin",
                "remaining_behavior", "min_abs_amount", "max_abs_amount")


def _bin_bounds(label: Column) -> tuple[Column, Column]:
    low = ladder([(label == name, float(lo)) for lo, _, name in AMOUNT_BINS], 0.0)
    high = ladder([(label == name, float(hi) if hi is not None else INF) for _, hi, name in AMOUNT_BINS], INF)
    return low, high


def suggest_company_rules(tx: DataFrame, selected: DataFrame, min_rows: int = 5, min_days: int = 3, min_share: float = 0.05,
                          min_bins: int = 2) -> DataFrame:
    """One series per selected company, or one per amount bin when enough bins carry weight."""
    rows = tx.join(selected.select("company_name", "position"), "company_name")
    by_bin = rows.groupBy("company_name", "position", "amount_bin").agg(
        F.count("*").alias("n_rows"), F.countDistinct(VALUE).alias("n_active_days"), F.sum("abs_amount").alias("_a"))
    company = Window.partitionBy("company_name")  # four bins at most
    total = F.sum("_a").over(company)
    meaningful = (F.col("n_rows") >= min_rows) & (F.col("n_active_days") >= min_days) & (F.col("_a") / total >= min_share)
    marked = by_bin.withColumn("_split", F.sum(meaningful.cast("int")).over(company) >= min_bins)
    low, high = _bin_bounds(F.col("amount_bin"))
    name = F.concat(F.lit("company__"), sanitize_label("company_name"), F.lit("__"))
    order = ladder([(F.col("amount_bin") == label, i) for i, (_, _, label) in enumerate(AMOUNT_BINS)], 99)
    split = marked.filter("_split").select(
        "company_name", "position", order.alias("_o"), F.col("amount_bin").alias("split_label"), low.alias("min_abs_amount"),
        high.alias("max_abs_amount"), F.concat(name, "amount_bin").alias("series_name"))
    whole = marked.filter("NOT _split").select("company_name", "position").distinct().select(
        "company_name", "position", F.lit(0).alias("_o"), F.lit("all").alias("split_label"), F.lit(0.0).alias("min_abs_amount"),
        F.lit(INF).alias("max_abs_amount"), F.concat(name, F.lit("all")).alias("series_name"))
    rules = split.unionByName(whole)
    # At most bins x budget rules, so their numbering is small.
    number = F.row_number().over(Window.orderBy("position", "_o"))
    return rules.select(
        (number + 999).alias("priority"), F.lit(True).alias("enabled"), "series_name", F.lit("selected_company").alias("rule_type"),
        "company_name", F.lit("*").alias("company_found"), F.lit("*").alias("amount_bin"), F.lit("*").alias("remaining_behavior"),
        "min_abs_amount", "max_abs_amount")


def remaining_behavior(tx: DataFrame, behaviors: DataFrame) -> DataFrame:
    """Company status, behaviour and group of rows outside the selected companies."""
    out = attach(tx, behaviors.select("company_name", F.col("behavior_group").alias("company_behavior")), ["company_name"])
    behavior, size = F.coalesce("company_behavior", F.lit("unknown_company")), F.col("amount_bin")
    label = ladder(
        [
            (size == "low", "low_weekly"),
            (size == "medium", "medium_intermittent"),
            (size.isin("high", "huge"), "rare_large"),
            (behavior.isin("periodic_weekly", "periodic_monthly"), behavior),
            (behavior.isin("intermittent_stable", "intermittent_lumpy", "lumpy_spiky"), "intermittent_lumpy"),
        ],
        "misc",
    )
    out = out.withColumns({"company_behavior": behavior, "company_status": F.when(F.col("company_found"), "known_company").otherwise("unknown_company"),
                           "remaining_behavior": label})
    return out.withColumn("remaining_group", F.concat_ws("__", "company_status", "amount_bin", "remaining_behavior"))


def remaining_coverage(remaining: DataFrame) -> DataFrame:
    """Candidate groups of the remaining rows."""
    return remaining.groupBy("remaining_group", "company_status", "amount_bin", "remaining_behavior").agg(
        F.count("*").alias("rows"), F.countDistinct(VALUE).alias("active_days"), F.sum("amount").alias("total_amount"),
        F.sum("abs_amount").alias("total_abs_amount"), F.countDistinct("company_key").alias("companies"))


def suggest_remaining_rules(groups: DataFrame, max_series: int = 15) -> DataFrame:
    """The largest groups as rules, the rest merged into one; groups are products of small label sets."""
    rank = F.row_number().over(Window.orderBy(F.desc("total_abs_amount"), "remaining_group"))
    many = groups.agg(F.count("*")).scalar() > max_series
    ranked = groups.withColumn("_r", rank).withColumn("_small", many & (F.col("_r") >= max_series))
    low, high = _bin_bounds(F.col("amount_bin"))
    kept = ranked.filter("NOT _small").select(
        "_r", F.concat(F.lit("remaining__"), sanitize_label("remaining_group", 100)).alias("series_name"),
        (F.col("company_status") == "known_company").cast("string").alias("company_found"), "amount_bin", "remaining_behavior",
        low.alias("min_abs_amount"), high.alias("max_abs_amount"))
    misc = ranked.filter("_small").groupBy().agg(F.min("_r").alias("_r")).filter("_r IS NOT NULL").select(
        "_r", F.lit("remaining__MISC_SMALL_REMAINING").alias("series_name"), F.lit("*").alias("company_found"), F.lit("*").alias("amount_bin"),
        F.lit("misc_small").alias("remaining_behavior"), F.lit(0.0).alias("min_abs_amount"), F.lit(INF).alias("max_abs_amount"))
    return kept.unionByName(misc).select(
        (F.col("_r") + 8999).alias("priority"), F.lit(True).alias("enabled"), "series_name", F.lit("remaining").alias("rule_type"),
        F.lit("*").alias("company_name"), "company_found", "amount_bin", "remaining_behavior", "min_abs_amount", "max_abs_amount")


_RULE_KEYS = ("company_name", "company_found", "amount_bin", "remaining_behavior")


def usable_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with every gap filled: a missing field matches anything, missing bounds are 0 and infinity,
    and a missing ``enabled`` is true, as are "true", "1" and "yes" in any case."""
    on = F.lower(F.trim(F.coalesce(F.col("enabled").cast("string"), F.lit("true")))).isin("true", "1", "yes")
    filled = {k: F.coalesce(F.col(k).cast("string"), F.lit("*")) if k in rules.columns else F.lit("*") for k in _RULE_KEYS}
    return rules.filter(on).withColumns({
        **filled, "min_abs_amount": F.coalesce(F.col("min_abs_amount").cast("double"), F.lit(0.0)),
        "max_abs_amount": F.coalesce(F.col("max_abs_amount").cast("double"), F.lit(INF))})


def assign_by_rules(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule per row by priority; ``*`` and a missing value match anything.

    The distinct field values of the rows meet the rules by equi-joins, once for each set of wildcards
    (a value is replaced by ``*`` where the rule has it). Per combination of values the amount ranges are
    then cut into disjoint spans with one winner each, so a row meets at most one span: no list per row,
    no row multiplied, no limit on the number of rules.
    """
    held = [k for k in _RULE_KEYS if k in tx.columns]
    usable = usable_rules(rules)
    named = {f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) if k in held else F.lit("\0") for k in _RULE_KEYS}
    values = [f"_{k}" for k in _RULE_KEYS]
    combos = tx.select(*[c.alias(v) for v, c in named.items()]).distinct()
    options = combos
    for k in _RULE_KEYS:
        choice = F.array(F.col(f"_{k}"), F.lit("*")) if k in held else F.array(F.lit("*"))
        options = options.withColumn(f"_r{k}", F.explode(choice))
    if "remaining_behavior" not in held:  # rows without the field: rules ignore it
        usable = usable.withColumn("remaining_behavior", F.lit("*"))
    rule = F.struct("priority", "series_name", "rule_type", *_RULE_KEYS[1:], "min_abs_amount", "max_abs_amount")
    named_rules = usable.select(*[F.col(k).alias(f"_r{k}") for k in _RULE_KEYS], rule.alias("_rule"))
    met = options.join(named_rules, [f"_r{k}" for k in _RULE_KEYS]).select(*values, "_rule")
    edges = met.select(*values, F.explode(F.array("_rule.min_abs_amount", "_rule.max_abs_amount")).alias("_lo")).distinct()
    after = F.lead("_lo").over(Window.partitionBy(*values).orderBy("_lo"))
    spans = edges.withColumn("_hi", after).filter("_hi IS NOT NULL")
    covers = (F.col("_rule.min_abs_amount") <= F.col("_lo")) & (F.col("_rule.max_abs_amount") >= F.col("_hi"))
    winners = spans.join(met, values).filter(covers).groupBy(*values, "_lo", "_hi").agg(F.min("_rule").alias("_m"))
    w = winners.select(*[F.col(v).alias(f"_w{v}") for v in values], "_lo", "_hi", "_m")
    # Rows meet their winner by expressions of their own columns, which are not shuffled beside them.
    on = [c == F.col(f"_w{v}") for v, c in named.items()] + [F.col("abs_amount") >= F.col("_lo"), F.col("abs_amount") < F.col("_hi")]
    return tx.join(w, on, "left").select(
        *tx.columns, F.col("_m.series_name").alias("series_name"), F.col("_m.rule_type").alias("matched_rule_type"),
        F.col("_m.priority").alias("matched_rule_priority"))


def assigned_summary(assigned: DataFrame) -> DataFrame:
    """Rows, days, amounts and companies per series, and its share of the whole amount.

    Rows are summed per (series, company, day) before anything distinct is counted. The total is that of the
    grouped sums: one row per rule, so its window is small.
    """
    keys = ["series_name", "matched_rule_type"]
    daily = assigned.groupBy(*keys, "company_key", VALUE).agg(F.count("*").alias("_n"), F.sum("amount").alias("_t"), F.sum("abs_amount").alias("_a"))
    out = daily.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.countDistinct(VALUE).alias("active_days"), F.sum("_t").alias("total_amount"),
        F.sum("_a").alias("total_abs_amount"), F.countDistinct("company_key").alias("companies"),
        F.min(VALUE).alias("first_date"), F.max(VALUE).alias("last_date"))
    return out.withColumn("share_total_abs", F.col("total_abs_amount") / F.sum("total_abs_amount").over(Window.partitionBy()))


# --- series by regime ----------------------------------------------------------------------


def assign_series_ids(tx: DataFrame, profile: DataFrame, tail_bins: bool = True, min_rows: int = 3, min_total: float = 25_000.0,
                      collapse: bool = True) -> DataFrame:
    """OWN, NO_COMPANY or TAIL series of every row; tiny tails are merged per regime."""
    traits = profile.select(*REGIME_KEYS, "is_own_series", "behavior_label", "freq_bin", "value_bin")
    rows = attach(tx, traits, REGIME_KEYS)
    parts = lambda *cols: F.concat_ws("__", "amount_regime", *cols, *([F.col("row_amount_bin")] if tail_bins else []))
    label = F.regexp_replace(F.regexp_replace(simple_company_name("company_clean"), "[^A-Z0-9]+", "_"), "^_|_$", "")
    own = F.concat_ws("__", "amount_regime", F.lit("OWN"), F.substring(F.coalesce(F.nullif(label, F.lit("")), F.lit("UNKNOWN")), 1, 80))
    first = ladder(
        [
            (F.col("company_clean") == NO_COMPANY, parts(F.lit("NO_COMPANY"))),
            (F.coalesce("is_own_series", F.lit(False)), own),
        ],
        parts(F.lit("TAIL"), F.col("behavior_label"), F.col("freq_bin"), F.col("value_bin")),
    )
    rows = rows.withColumn("initial_series_id", first)
    if collapse:
        info = rows.groupBy("initial_series_id").agg(F.count("*").alias("_n"), F.sum("abs_amount").alias("_a"))
        # Tails are products of short label lists: every task gets the tiny ones, and rows are not shuffled for them.
        tiny = info.filter(F.col("initial_series_id").contains("__TAIL__") & ((F.col("_n") < min_rows) | (F.col("_a") < min_total)))
        rows = attach(rows, F.broadcast(tiny.select("initial_series_id", F.lit(True).alias("_tiny"))), ["initial_series_id"])
        merged = F.concat("amount_regime", F.lit("__TAIL__MISC_TINY"))
        rows = rows.withColumn("series_id", F.when(F.col("_tiny"), merged).otherwise(F.col("initial_series_id"))).drop("_tiny")
    else:
        rows = rows.withColumn("series_id", F.col("initial_series_id"))
    kind = ladder([(F.col("series_id").contains("__OWN__"), "own_company"), (F.col("series_id").contains("__NO_COMPANY"), "no_company"),
                   (F.col("series_id").contains("__TAIL__"), "tail_group")], "other")
    return rows.withColumn("series_type", kind)


def series_info(assigned: DataFrame, sample: int = 8) -> DataFrame:
    """Metadata per series: sizes, dates, shares and the largest companies."""
    info = assigned.groupBy("series_id", "amount_regime", "series_type").agg(
        F.count("*").alias("n_rows"), F.countDistinct("company_clean").alias("n_companies"), F.countDistinct(VALUE).alias("n_active_days"),
        F.sum("amount").alias("total_amount"), F.sum("abs_amount").alias("total_abs_amount"), F.avg("abs_amount").alias("mean_abs_movement"),
        F.max("abs_amount").alias("max_abs_movement"), F.min(VALUE).alias("first_date"), F.max(VALUE).alias("last_date"))
    by_company = assigned.groupBy("series_id", "company_clean").agg(F.sum("abs_amount").alias("_a"))
    top = by_company.groupBy("series_id").agg(F.when(F.sum("_a") > 0, F.max("_a") / F.sum("_a")).alias("top_company_abs_share"))
    names = string_sample(assigned, ["series_id"], "company_clean", "abs_amount", sample).withColumnRenamed("sample", "top_companies_sample")
    regime = info.groupBy("amount_regime").agg(F.sum("total_abs_amount").alias("_g"))
    total = info.agg(F.sum("total_abs_amount")).scalar()
    out = attach(attach(attach(info, top, ["series_id"]), names, ["series_id"]), regime, ["amount_regime"])
    return out.withColumns({"share_total_abs": F.col("total_abs_amount") / total, "share_regime_abs": F.col("total_abs_amount") / F.col("_g")}).drop("_g")


def company_to_series(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("amount_regime", "company_clean", "series_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct(VALUE).alias("n_active_days"), F.sum("amount").alias("total_amount"),
        F.sum("abs_amount").alias("total_abs_amount"), F.first("series_type").alias("series_type"))


def series_coverage(info: DataFrame) -> DataFrame:
    out = info.groupBy("amount_regime", "series_type").agg(
        F.count("*").alias("n_series"), F.sum("total_amount").alias("total_amount"), F.sum("total_abs_amount").alias("total_abs_amount"),
        F.sum("n_rows").alias("n_rows"), F.sum("n_companies").alias("n_companies"))
    # Two regimes and a handful of types are left here.
    share = lambda w: F.col("total_abs_amount") / F.sum("total_abs_amount").over(w)
    return out.withColumns({"share_abs_all": share(Window.partitionBy()), "share_abs_regime": share(Window.partitionBy("amount_regime"))})


def tail_audit(info: DataFrame) -> DataFrame:
    return info.filter("series_type = 'tail_group'").select(
        "series_id", "amount_regime", "n_rows", "n_companies", "total_abs_amount", "top_company_abs_share", "top_companies_sample"
    ).orderBy(F.desc("top_company_abs_share"), F.desc("total_abs_amount"))


def company_landscape(profile: DataFrame) -> DataFrame:
    named = profile.filter(F.col("company_clean") != NO_COMPANY)
    return named.groupBy("amount_regime", "freq_bin").agg(
        F.countDistinct("company_clean").alias("companies"), F.sum("total_abs_amount").alias("total_abs_amount"),
        (F.sum("total_abs_amount") / F.countDistinct("company_clean")).alias("avg_abs_per_company"))


def review_not_selected(profile: DataFrame) -> DataFrame:
    return profile.filter("NOT is_own_series").select(
        "amount_regime", "company_clean", "n_rows", "n_active_days", "total_amount", "total_abs_amount", "share_split_abs", "behavior_label",
        "freq_bin", "value_bin", "adi", "cv2_daily_abs_amount", "median_gap_days", "cv_gap_days", "dow_top_share", "dom_top_share", "own_score",
        "own_reason").orderBy(F.desc("total_abs_amount"), F.desc("n_rows"))


# Named granularities (budget under, budget over, least tail total).
SCENARIOS = {"compact": (25, 15, 100_000.0), "balanced": (60, 40, 25_000.0), "detailed": (120, 80, 5_000.0)}


def scenario_summary(tx: DataFrame, profile: DataFrame, name: str, under: int, over: int, min_total: float) -> DataFrame:
    """Series counts and amount shares of one configuration."""
    from .companies import OVER, OWN_LIMITS, UNDER

    limits = {UNDER: (under, *OWN_LIMITS[UNDER][1:]), OVER: (over, *OWN_LIMITS[OVER][1:])}
    assigned = assign_series_ids(tx, select_own_series(profile, limits), min_total=min_total)
    per_series = assigned.groupBy("series_id", "series_type").agg(F.sum("abs_amount").alias("a"))
    of = lambda kind: F.count_if(F.col("series_type") == kind)
    share = lambda kind: F.sum(F.when(F.col("series_type") == kind, F.col("a")).otherwise(0.0)) / F.sum("a")
    kinds = {"own": "own_company", "tail": "tail_group", "no_company": "no_company"}
    return per_series.agg(
        F.lit(name).alias("scenario"), F.count("*").alias("n_series"), of("own_company").alias("n_own_company_series"),
        of("tail_group").alias("n_tail_group_series"), of("no_company").alias("n_no_company_series"),
        *[share(kind).alias(f"{short}_abs_share") for short, kind in kinds.items()])


def scenario_compare(df: DataFrame, scenarios=None) -> DataFrame:
    """The same rows under several configurations; rows and profiles are prepared once.

    Each configuration is written by itself, so that the shuffle files of one go before the next.
    """
    layers = Layers(df.sparkSession, "scenarios")
    tx = layers.get("tx", lambda: prepare_transactions(df).select(VALUE, "amount", "abs_amount", "company_clean", "amount_regime", "row_amount_bin"))
    profile = layers.get("profile", lambda: regime_profile(tx, layers))
    layers.drop(*PROFILE_STEPS)
    out = None
    for i, (name, (under, over, total)) in enumerate((scenarios or SCENARIOS).items()):
        part = layers.get(f"scenario-{i}", lambda: scenario_summary(tx, profile, name, under, over, total))  # noqa: B023
        out = part if out is None else out.unionByName(part)
    return out


