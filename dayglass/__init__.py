"""User-day behavioural analytics on Spark."""

from dayglass.contract import (
    EMAIL_FEATURES,
    FEATURES,
    HTTP_FEATURES,
    LOGON_FEATURES,
    Params,
)
from dayglass.operators.diagnostics import evaluate
from dayglass.operators.features import email_features, http_features, logon_features
from dayglass.operators.fusion import align, fuse
from dayglass.plans.detect import explain, full_diagnostics, global_importance, matrix, run
from dayglass.plans.model import Model, fit, load_model, save_model, score

__all__ = [
    "EMAIL_FEATURES",
    "FEATURES",
    "HTTP_FEATURES",
    "LOGON_FEATURES",
    "Model",
    "Params",
    "align",
    "email_features",
    "evaluate",
    "explain",
    "fit",
    "full_diagnostics",
    "fuse",
    "global_importance",
    "http_features",
    "load_model",
    "logon_features",
    "matrix",
    "run",
    "save_model",
    "score",
]
