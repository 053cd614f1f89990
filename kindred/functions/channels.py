"""Retrieval channels as bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit and name of each channel.
CHANNELS = {1: "exact_name", 2: "exact_address", 4: "address_digits", 8: "rare_token", 16: "ngram"}
EXACT_NAME, EXACT_ADDRESS, ADDRESS_DIGITS, RARE_TOKEN, NGRAM = CHANNELS


def has(bits: str | Column, bit: int) -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(bit)) > 0


def bits_to_channels(bits: str | Column) -> Column:
    """Names in bit order, joined by '|'."""
    return F.concat_ws("|", *[F.when(has(bits, b), F.lit(n)) for b, n in CHANNELS.items()])


def n_channels(bits: str | Column) -> Column:
    return F.bit_count(bits).cast("int")
