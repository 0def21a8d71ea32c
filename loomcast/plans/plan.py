"""The plan builder: transforms and filters below the expensive operator, the operator, transforms above.

A filter above a Python operator stays above it, so what can spare a call must be declared here as
``skip`` or ``before``; the builder puts it below.
"""

from __future__ import annotations

import functools
import operator
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.config import EngineConfig
from loomcast.operators import infer, stats
from loomcast.operators.strategies import Strategy
from loomcast.schema import DRY_RUN_PREFIX, SKIPPED, TOKENS

Transform = Callable[[DataFrame], DataFrame]


def dry_run_output(prompt: Column) -> Column:
    return F.concat(F.lit(DRY_RUN_PREFIX), F.substring(prompt, 1, 50), F.lit("..."))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def no_tokens() -> Column:
    return F.struct(*[F.lit(0).cast("bigint").alias(k) for k in stats.TOKEN_KINDS]).cast(TOKENS)


def skipped_results(items: DataFrame) -> DataFrame:
    """Failed results of items that are not called, in the form of ``stats.results``."""
    null = F.lit(None).cast("string")
    context = F.col("context").cast("string") if "context" in items.columns else null
    return items.select("item_id", F.lit(False).alias("success"), null.alias("output"), F.lit(SKIPPED).alias("error"), no_tokens().alias("token_usage"), F.lit(0).cast("bigint").alias("failed_attempt_tokens"), F.lit(0).cast("bigint").alias("attempts"), F.lit(0).alias("generations"), context.alias("context"))


class Middleware:
    """Passes everything through; override what is needed and add it by ``InferencePlan.use``."""

    def before(self, items: DataFrame) -> DataFrame:
        return items

    def skip(self) -> Column | None:
        return None

    def after(self, results: DataFrame) -> DataFrame:
        return results

    def on_error(self) -> Column | None:
        """An output for a failed result, or null."""
        return None


def isolated(f: Transform, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``f(df)``; a step that raises, or loses one of the columns ``keep``, is left out with a warning. What a
    step does to a row is in expressions, which say themselves what a bad value gives (``try_`` functions)."""
    try:
        out = f(df)
        if lost := [c for c in keep if c not in out.columns]:
            raise ValueError(f"it loses {lost}")
    except Exception as e:
        warnings.warn(f"a failing step is left out: {type(e).__name__}: {e}", stacklevel=3)
        return df
    return out


def _call_columns(items: DataFrame) -> list[str]:
    """What a call depends on."""
    return ["prompt", *[c for c in ("strategy", "model", "temperature") if c in items.columns]]


def given_back(call: DataFrame, called: DataFrame, found: DataFrame) -> DataFrame:
    """Results ``found`` of the items ``called`` (one for each distinct call) for all items ``call``, with their own contexts."""
    keys = _call_columns(call)
    own = call.select(F.col("item_id").alias("own_id"), (F.col("context").cast("string") if "context" in call.columns else F.lit(None).cast("string")).alias("own_context"), *[F.col(k).alias(f"own_{k}") for k in keys])
    same = functools.reduce(operator.and_, [F.col(f"own_{k}").eqNullSafe(F.col(k)) for k in keys])
    firsts = own.join(called.select("item_id", *keys), same).select("own_id", "own_context", "item_id")
    both = firsts.join(found, "item_id")
    return both.select(*[F.col("own_id").alias(c) if c == "item_id" else F.col("own_context").alias(c) if c == "context" else F.col(c) for c in found.columns])


@dataclass(frozen=True)
class InferencePlan:
    items: DataFrame
    strategies: dict[str, Strategy] = field(default_factory=dict)
    config: EngineConfig = field(default_factory=EngineConfig)
    steps: tuple[Transform, ...] = ()
    afters: tuple[Transform, ...] = ()
    handlers: tuple[Column, ...] = ()
    skips: tuple[Column, ...] = ()
    reuse_prompts: bool = False

    def before(self, f: Transform) -> InferencePlan:
        """Rewrite items; steps run in the order they are given."""
        return replace(self, steps=(*self.steps, f))

    def skip(self, when: Column) -> InferencePlan:
        """Items for which ``when`` holds after all steps fail without a call."""
        return replace(self, skips=(*self.skips, when))

    def after(self, f: Transform) -> InferencePlan:
        """Rewrite successful results; the last given runs first."""
        return replace(self, afters=(*self.afters, f))

    def on_error(self, recovered: Column) -> InferencePlan:
        """An output for failed results; the first handler that gives one makes the result a success."""
        return replace(self, handlers=(*self.handlers, recovered))

    def use(self, middleware: Middleware) -> InferencePlan:
        """All hooks of ``middleware``: before-hooks run in the order of use, after-hooks in reverse."""
        plan = self.before(middleware.before).after(middleware.after)
        try:
            skip, handler = middleware.skip(), middleware.on_error()
        except Exception as e:
            warnings.warn(f"a failing hook is left out: {type(e).__name__}: {e}", stacklevel=2)
            return plan
        plan = plan if skip is None else plan.skip(skip)
        return plan if handler is None else plan.on_error(handler)

    def dedupe_prompts(self) -> InferencePlan:
        """Call once for each prompt (with strategy, model and temperature, where there are any), and give all items with it that result."""
        return replace(self, reuse_prompts=True)

    def prepared(self) -> tuple[DataFrame, DataFrame]:
        """(items to call, items to skip)."""
        df = self.items
        for f in self.steps:
            df = isolated(f, df, ("item_id", "prompt"))
        if not self.skips:
            return df, df.limit(0)
        skip = F.coalesce(self.skips[0], F.lit(False))
        for s in self.skips[1:]:
            skip = skip | F.coalesce(s, F.lit(False))
        return df.where(~skip), df.where(skip)

    def attempts(self) -> DataFrame:
        """The lazy attempt log of the items that are called; every action on it calls again."""
        return infer.infer(self._called(self.prepared()[0]), self.strategies, self.config)

    def _called(self, items: DataFrame) -> DataFrame:
        if not self.reuse_prompts:
            return items
        return items.groupBy(*_call_columns(items)).agg(F.min("item_id").alias("item_id"))

    def run(self, path: str) -> DataFrame:
        """Call, write the log at ``path`` (items it already has are not called again), and return results."""
        call, skip = self.prepared()
        spark = self.items.sparkSession
        called = self._called(call)
        found = stats.results(infer.run(called, path, self.strategies, self.config))
        if self.reuse_prompts:
            found = given_back(call, called, found)
        return self.finish(found.unionByName(skipped_results(skip)))

    def finish(self, found: DataFrame) -> DataFrame:
        """Handlers on failures, then the after-transforms on successes."""
        if self.handlers:
            output = F.coalesce(*self.handlers)
            rescued = ~F.col("success") & (F.col("error") != SKIPPED) & output.isNotNull()
            found = found.withColumn("_rescued", rescued).withColumn("output", F.when(F.col("_rescued"), output).otherwise(F.col("output")))
            found = found.withColumn("success", F.col("success") | F.col("_rescued")).withColumn("error", F.when(~F.col("_rescued"), F.col("error"))).drop("_rescued")
        if self.afters:
            good, bad = found.where("success"), found.where("not success")
            for f in reversed(self.afters):
                good = isolated(f, good, ("item_id", "success"))
            found = good.unionByName(bad, allowMissingColumns=True)
        return found
