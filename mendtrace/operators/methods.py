"""Cleaning methods by name, as the comparisons of methods call them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from ..functions.core import IDX, KEY, SHORT_GAP_SECONDS, gap_limit
from . import repair as R
from .diagnostics import diagnose
from .generative import GaussianHMM
from .states import predict_regimes


def methods(fs: Column, width: float, height: float, model: GaussianHMM | None = None, seconds: float = SHORT_GAP_SECONDS, key: Sequence[str] = KEY, idx: str = IDX) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The nine methods; fs is the sampling rate of a row's series. gaussian_hmm needs a fitted model, oracle_policy the
    column true_regime; both and viterbi_d add pred_regime."""

    def by_states(df: DataFrame) -> DataFrame:
        return R.repair(predict_regimes(diagnose(df, width, height, key, idx), fs, seconds, key, idx, "pred_regime"), "pred_regime", key, idx)

    def by_model(df: DataFrame) -> DataFrame:
        if model is None:
            raise ValueError("gaussian_hmm needs a fitted model")
        return R.repair(model.predict(diagnose(df, width, height, key, idx), "pred_regime", key, idx), "pred_regime", key, idx)

    return {**R.cleaners(width, height, key, idx, gap_limit(fs, seconds)), "viterbi_d": by_states, "gaussian_hmm": by_model, "oracle_policy": lambda df: R.oracle_policy(diagnose(df, width, height, key, idx), key, idx)}


def run_method(name: str, df: DataFrame, fs: Column, width: float, height: float, **how) -> DataFrame:
    known = methods(fs, width, height, **how)
    if name not in known:
        raise ValueError(f"no method {name}; there are {sorted(known)}")
    return known[name](df)
