"""The list of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallywing.sources.fixture import transactions, with_transactions

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a function of (spark, sf_dir); `oracle` reads the driver tables."""

    def wrap(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(build, oracle)
        return build

    return wrap


def on_transactions(
    name: str, oracle: str | None = None, state: bool = False, event_time: str = "spread", **params
):
    """Register a function of the transaction frame, run with `params`.

    `oracle` reads the view `transactions`. `state` says whether `sender_state` is
    read; only then does the frame need its joins.
    """

    def wrap(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        register(name, oracle and with_transactions(oracle, event_time))(
            lambda spark, sf_dir: build(transactions(spark, sf_dir, state, event_time), **params)
        )
        return build

    return wrap
