"""Similarity search over 64-bit hashes held in signed bigint columns, on Spark."""

from bitnear.functions.bits import area, equal_bits, from_bitstring, hamming, to_bitstring, within, within_area
from bitnear.functions.sql import register, register_search
from bitnear.operators.ball import ball_filter, nearest
from bitnear.operators.join import similarity_join
from bitnear.operators.pivot import append_pivot_layout, choose_pivots, pivot_ball_filter, write_pivot_layout
from bitnear.operators.search import batch_search
from bitnear.operators.skew import heavy_keys, per_key_join, skew_join

__all__ = [
    "append_pivot_layout",
    "area",
    "ball_filter",
    "batch_search",
    "choose_pivots",
    "equal_bits",
    "from_bitstring",
    "hamming",
    "heavy_keys",
    "nearest",
    "per_key_join",
    "pivot_ball_filter",
    "register",
    "register_search",
    "similarity_join",
    "skew_join",
    "to_bitstring",
    "within",
    "within_area",
    "write_pivot_layout",
]
