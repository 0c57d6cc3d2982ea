"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.plans import claims, evaluation, seams, texts, texts_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**claims.QUERIES, **texts.QUERIES, **evaluation.QUERIES, **seams.QUERIES}
SQL: dict[str, str] = {**claims.SQL, **texts_sql.SQL, **evaluation.SQL, **seams.SQL}
