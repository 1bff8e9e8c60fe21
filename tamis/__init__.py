"""tamis: a Spark-native engine for curating, splitting and evaluating labelled corpora."""

from tamis.session import get_session

__all__ = ["get_session"]
