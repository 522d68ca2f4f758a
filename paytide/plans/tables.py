"""Fixture tables derived from the given parquet files, shared by the registered queries."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gold as G
from ..operators import silver as S
from ..operators.backtest import FoldData, backtest_errors
from ..operators.baselines import BASELINES
from ..operators.companies import PROFILE_STEPS, clean_movement_extract, company_profile_events, prepare_transactions, regime_profile, select_companies, select_own_series
from ..operators.evaluate import simple_candidates
from ..operators.pointintime import FeatureSpec, dataset_build, gold_calendar_bounds
from ..operators.rules import ColumnRule, Ruleset
from ..operators.series import add_band_columns
from ..schema import TableShape, movement_shape
from ..sources.layers import Layers
from .oracle import CTES

RULESET = Ruleset(
    name="fixture",
    filters={
        "APPLICATIVE_STATUS_SHORTNAME": ColumnRule(include_values=("O", "F")),
        "CASH_MOVEMENT_TYPE_SHORTNAME": ColumnRule(exclude_values=("n+",)),
        "DESCRIPTION": ColumnRule(exclude_contains=("lamp", "a.b(c)")),
    },
    movement_scope_mapping={"R+": "REFUND"},
)
GRAIN = ("ENTITY_SHORTNAME", "CURRENCY_SHORTNAME", "MOVEMENT_SCOPE")
EVAL_FROM, EVAL_TO, TRAIN_WINDOW = "2000-01-01", "2000-03-31", 90
SPEC = FeatureSpec(history=28)


class Tables:
    """Lazy DataFrames; nothing here runs before the query that uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.layers = Layers(spark, "series-layers")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def with_parts(self, lines: DataFrame) -> DataFrame:
        part = self.table("part")
        return lines.join(part, lines.l_partkey == part.p_partkey)

    def with_customers(self, lines: DataFrame) -> DataFrame:
        """Lines with the customer of their order: the far smaller orders meet the customers first."""
        orders, customer, nation, region = (self.table(name) for name in ("orders", "customer", "nation", "region"))
        ordered = (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select("o_orderkey", "c_name", "n_name", "r_name")
        )
        return lines.join(ordered, lines.l_orderkey == ordered.o_orderkey)

    @cached_property
    def movements(self) -> DataFrame:
        return self.movements_of(self.with_customers(self.with_parts(self.table("lineitem"))))

    def movements_of(self, joined: DataFrame) -> DataFrame:
        value = F.col("l_shipdate").cast("date")
        sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
        signed = F.col("l_extendedprice") * sign
        return joined.select(
            F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("ID"),
            F.col("n_name").alias("ENTITY_SHORTNAME"),
            F.col("r_name").alias("CURRENCY_SHORTNAME"),
            F.concat("l_returnflag", F.lit("+")).alias("CASH_MOVEMENT_TYPE_SHORTNAME"),
            F.col("l_linestatus").alias("APPLICATIVE_STATUS_SHORTNAME"),
            F.col("p_brand").alias("ACCOUNT_SHORTNAME"),
            F.col("c_name").alias("CPTY_NAME"),
            F.concat(F.lit("/BO/"), F.upper("c_name"), F.lit(" S.A./"), "p_name").alias("DESCRIPTION"),
            F.date_add(value, (F.col("l_partkey") % 11 - 7).cast("int")).alias("TRADE_DATE"),
            value.alias("VALUE_DATE"),
            F.col("l_extendedprice").alias("AMOUNT"),
            sign.alias("SIGN"),
            F.when(F.col("l_partkey") % 13 == 0, None)
            .when(F.col("l_partkey") % 17 == 0, signed + 1.0)
            .otherwise(signed)
            .alias("SIGNED_AMOUNT"),
        )

    @cached_property
    def shape(self) -> TableShape:
        have = set(self.movements.columns)
        return TableShape("movements", tuple(f for f in movement_shape().fields if f.name in have))

    @cached_property
    def silver(self) -> DataFrame:
        return S.flag_duplicate_ids(S.quality_flags(self.movements, self.shape))

    @cached_property
    def bronze(self) -> DataFrame:
        """Text rows with blanks, decimal commas, mixed date formats and bad values, from lineitem."""
        self.table("lineitem").createOrReplaceTempView("lineitem")
        return self.spark.sql(CTES["bronze_raw"])

    @cached_property
    def scoped(self) -> DataFrame:
        return G.gold_filtered(self.movements, RULESET)

    @cached_property
    def known(self) -> DataFrame:
        """Kept in memory and on disk: Gold is a written layer that every later step reads."""
        return G.gold_known(self.scoped, RULESET).persist()

    @cached_property
    def realized(self) -> DataFrame:
        return G.realized_from_known(self.known, RULESET)

    @cached_property
    def gold(self) -> dict[str, DataFrame]:
        return {"realized": self.realized, "known": self.known}

    @cached_property
    def known_grain(self) -> DataFrame:
        return G.gold_known(self.scoped, RULESET, GRAIN).persist()

    @cached_property
    def realized_grain(self) -> DataFrame:
        return G.realized_from_known(self.known_grain, RULESET, GRAIN)

    @cached_property
    def gold_grain(self) -> dict[str, DataFrame]:
        return {"realized": self.realized_grain, "known": self.known_grain}

    @cached_property
    def calendar(self) -> DataFrame:
        return G.calendar_from_gold(self.realized, self.known)

    @cached_property
    def folds(self) -> FoldData:
        return FoldData(self.realized, self.known, EVAL_FROM, EVAL_TO, TRAIN_WINDOW, SPEC).cache()

    @cached_property
    def span(self):
        """First and last day of the Gold tables as scalar subqueries."""
        return gold_calendar_bounds(self.realized, self.known)

    @cached_property
    def day_rows(self) -> DataFrame:
        """Features and final labels of every cutoff of the calendar."""
        return dataset_build(self.realized, self.known, *self.span, SPEC)

    @cached_property
    def eval_rows(self) -> DataFrame:
        return dataset_build(self.realized, self.known, EVAL_FROM, EVAL_TO, SPEC)

    @cached_property
    def tx(self) -> DataFrame:
        """Cleaned movement extract of all movement types, a written layer; one account has no company text.

        Each wide join is written by itself, so that the shuffle files of one go before the next; the rows then lie by
        order, so that those of one ID combine before they are shuffled. The extract holds the columns that later steps read.
        """
        lines = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus", "p_name", "p_brand")
        names = ("ID", "VALUE_DATE", "TRADE_DATE", "amount", "abs_amount", "amount_bin", "company_name", "company_found", "company_key", "dayofweek",
                 "day_name", "dayofmonth")

        def joined() -> DataFrame:
            parts = self.layers.get("line-parts", lambda: self.with_parts(self.table("lineitem")).select(*lines))
            return self.with_customers(parts).select(*lines, "c_name", "n_name", "r_name")

        def cleaned() -> DataFrame:
            movements = self.movements_of(self.layers.get("joined", joined))
            self.layers.drop("line-parts")
            kept = movements.select("ID", "TRADE_DATE", "VALUE_DATE", "AMOUNT", "ENTITY_SHORTNAME", "CURRENCY_SHORTNAME",
                                    "CASH_MOVEMENT_TYPE_SHORTNAME", "ACCOUNT_SHORTNAME", "DESCRIPTION", "SIGNED_AMOUNT")
            text = F.when(F.col("ACCOUNT_SHORTNAME") == "Brand#7", "123/45").otherwise(F.col("DESCRIPTION"))
            return clean_movement_extract(kept.withColumn("DESCRIPTION", text)).select(*names)

        tx = self.layers.get("tx", cleaned)
        self.layers.drop("joined")
        return tx

    @cached_property
    def tx_span(self):
        """First and last landing day of the extract as scalar subqueries."""
        both = self.tx.agg(F.struct(F.min("VALUE_DATE").alias("lo"), F.max("VALUE_DATE").alias("hi")).alias("b")).scalar()
        return both["lo"], both["hi"]

    @cached_property
    def banded(self) -> DataFrame:
        return add_band_columns(self.tx)

    @cached_property
    def prepared(self) -> DataFrame:
        """Regimes split at 50,000, since fixture amounts stay below 100,000; the columns that later steps read."""
        names = ("ID", "VALUE_DATE", "amount", "abs_amount", "company_clean", "company_found_clean", "amount_regime", "row_amount_bin",
                 "is_month_end_window", "is_month_start_window")
        return self.layers.get("prepared", lambda: prepare_transactions(self.tx, threshold=50_000.0).select(*names))

    @cached_property
    def regime_profile(self) -> DataFrame:
        return self.profiled("regime_profile", lambda: regime_profile(self.prepared, self.layers))

    @cached_property
    def company_events(self) -> DataFrame:
        return self.profiled("company_events", lambda: company_profile_events(self.tx, self.layers))

    def profiled(self, name: str, build) -> DataFrame:
        """A layer of an event profile; the measures of days, which it holds, are removed."""
        profile = self.layers.get(name, build)
        self.layers.drop(*PROFILE_STEPS)
        return profile

    @cached_property
    def selected(self) -> DataFrame:
        """Selected companies with their position; at most the selection budget of rows."""
        chosen = select_companies(self.company_events).filter("is_selected_company")
        order = Window.orderBy(F.desc("company_score"), F.desc("total_abs_amount"), F.desc("n_rows"), "company_name")
        return self.layers.get("selected", lambda: chosen.select("company_name", F.row_number().over(order).alias("position")))

    @cached_property
    def own_series(self) -> DataFrame:
        return self.layers.get("own_series", lambda: select_own_series(self.regime_profile))

    @cached_property
    def all_rows(self) -> DataFrame:
        """Features and final labels of every day of the calendar."""
        spec = FeatureSpec(windows={7: ("mean",), 28: ("mean",)}, history=28, cross=False)
        bounds = gold_calendar_bounds(self.realized, self.known)
        return dataset_build(self.realized, self.known, *bounds, spec).persist()

    @cached_property
    def simple(self) -> DataFrame:
        """The simple candidate runs over every day, scored."""
        return simple_candidates(self.all_rows)

    @cached_property
    def predictions(self) -> DataFrame:
        """The four baseline runs in one table."""
        training, inference = self.folds.training(()), self.folds.inference()
        out = None
        for name, model in BASELINES.items():
            run = backtest_errors(model(training, inference)).withColumn("RUN_NAME", F.lit(name))
            out = run if out is None else out.unionByName(run)
        return out
