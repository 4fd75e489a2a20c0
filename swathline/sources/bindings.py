"""Geometry derived from the input tables, the same arithmetic in every engine: tables of points, poses, cells and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses in the order of time, by vehicle."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", (8.5 + (F.col("event_id") % 997) * 1e-4).alias("lng"), (47.3 + (F.col("user_id") % 89) * 1e-4).alias("lat"), (500 + F.col("value")).alias("alt")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of a point cloud."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 0.5 + F.col("l_linenumber")).alias("x"), (F.col("l_suppkey") * 3.0 + F.col("l_quantity")).alias("y"),
        F.col("l_extendedprice").alias("w"), F.col("l_returnflag").alias("class"), F.col("l_discount").alias("d"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain cells of 100 m in a grid of twenty columns, with a bearing and a confidence."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("cell"), F.floor(key / 20).alias("row"), (key % 20).alias("col"), F.col("p_retailprice").alias("z"), F.pmod(F.col("p_retailprice") * 7, F.lit(180.0)).alias("bearing"), (F.col("p_size") / 50).alias("conf"),
        F.col("p_brand").alias("region"), (50.0 + F.col("p_size")).alias("area"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes about a centre, one a supplier, in degrees and as rings of points x, y."""
    half = 0.001 + F.abs("s_acctbal") * 1e-7
    lng, lat = 8.5 + F.col("s_suppkey") * 1e-3, F.lit(47.3)
    corner = lambda dx, dy: F.struct((lng + dx * half).alias("x"), (lat + dy * half).alias("y"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("area_id"), lng.alias("lng"), lat.alias("lat"), half.alias("half"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring")
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with a quality cost, a time and a group."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan"), F.col("o_totalprice").alias("quality"), F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("time"), (F.col("o_custkey") % 8).alias("bucket"), F.col("o_orderpriority").alias("kind")
    )


def rounded(c: Column, places: int) -> Column:
    """A double to so many places as SQL engines of doubles have it: scaled, then the nearest whole number, halves away from 0.

    Spark's own goes by the shortest decimal text, which calls some numbers halves that lie beside them.
    """
    scaled = F.abs(c) * 10.0**places
    whole = F.floor(scaled)
    nearest = whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)
    return F.when(scaled < float(1 << 52), F.signum(c) * nearest / 10.0**places).otherwise(c)


#: The same tables in SQL, for the comparison.
SQL = {
    "poses": "SELECT event_id, user_id, ts, event_type, 8.5::DOUBLE + (event_id % 997) * 1e-4 AS lng, 47.3::DOUBLE + (user_id % 89) * 1e-4 AS lat, 500 + value AS alt FROM events",
    "points": "SELECT l_orderkey, l_linenumber, l_partkey * 0.5::DOUBLE + l_linenumber AS x, l_suppkey * 3.0::DOUBLE + l_quantity AS y, l_extendedprice AS w, l_returnflag AS class, l_discount AS d FROM lineitem",
    "cells": "SELECT p_partkey AS cell, p_partkey // 20 AS row, p_partkey % 20 AS col, p_retailprice AS z, fmod(p_retailprice * 7, 180::DOUBLE) AS bearing, p_size / 50::DOUBLE AS conf, p_brand AS region, 50::DOUBLE + p_size AS area FROM part",
    "areas": "SELECT s_suppkey AS area_id, 8.5::DOUBLE + s_suppkey * 1e-3 AS lng, 47.3::DOUBLE AS lat, 0.001::DOUBLE + abs(s_acctbal) * 1e-7 AS half FROM supplier",
    "plans": "SELECT o_orderkey AS plan, o_totalprice AS quality, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS time, o_custkey % 8 AS bucket, o_orderpriority AS kind FROM orders",
}


def with_tables(sql: str, *names: str) -> str:
    """sql with these tables in front, as common table expressions."""
    tables, sql = ", ".join(f"{n} AS ({SQL[n]})" for n in names), sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{tables}, {sql.removeprefix(start)}"
    return f"WITH {tables} {sql}"
