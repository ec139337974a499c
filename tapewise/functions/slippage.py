"""Pluggable slippage: a model turns the price of a leg into the price paid.

A model is an expression over columns of the trip, so it may look at sizes or
coins as well; any subclass of ``SlippageModel`` can be given to ``slipped``.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F


class SlippageModel(ABC):
    """What a leg's price becomes: a buyer pays no less, a seller gets no more."""

    @property
    @abstractmethod
    def identifier(self) -> str:
        """A short name for reports."""

    @abstractmethod
    def leg(self, buys: Column, mid: Column) -> Column:
        """Price of a leg at ``mid``; ``buys`` tells a buy from a sale. Null stays null."""

    def round_trip(self, side: Column, entry: Column, exit_: Column) -> tuple[Column, Column]:
        """Entry and exit prices of a trip: a long buys first, a short last."""
        long = side == "long"
        return self.leg(long, entry), self.leg(~long, exit_)


class LinearBps(SlippageModel):
    """Every leg worse by ``bps`` of its price, whatever its size; less than 0 counts as 0."""

    def __init__(self, bps: float) -> None:
        self.bps = float(bps)

    @property
    def identifier(self) -> str:
        return f"linear_{self.bps:.2f}_bps_per_leg"

    def leg(self, buys: Column, mid: Column) -> Column:
        m = max(self.bps, 0.0) / 10_000.0
        return mid * F.when(buys, 1.0 + m).otherwise(1.0 - m)
