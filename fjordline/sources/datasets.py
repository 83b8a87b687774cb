"""Classic series, as DataFrames (ts date, value double) or arrays.

Four short ones are stated below.  Sunspots and GDP growth are longer; their loaders read a CSV of one value a
line (or any file of Spark's readers) whose path is a parameter, and add the dates.
"""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Published observations, in order of time.
NILE = (
    1120, 1160, 963, 1210, 1160, 1160, 813, 1230, 1370, 1140, 995, 935, 1110, 994, 1020, 960, 1180, 799, 958, 1140, 1100, 1210, 1150, 1250, 1260,
    1220, 1030, 1100, 774, 840, 874, 694, 940, 833, 701, 916, 692, 1020, 1050, 969, 831, 726, 456, 824, 702, 1120, 1100, 832, 764, 821, 768, 845, 864,
    862, 698, 845, 744, 796, 1040, 759, 781, 865, 845, 944, 984, 897, 822, 1010, 771, 676, 649, 846, 812, 742, 801, 1040, 860, 874, 848, 890, 744,
    749, 838, 1050, 918, 986, 797, 923, 975, 815, 1020, 906, 901, 1170, 912, 746, 919, 718, 714, 740,
)
AIRLINE = (
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140, 145, 150, 178, 163, 172,
    178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194, 196, 196, 236, 235, 229, 243, 264, 272, 237, 211,
    180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229, 242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317,
    313, 318, 374, 413, 405, 355, 306, 271, 306, 315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336, 340, 318, 362, 348, 363, 435, 491, 505,
    404, 359, 310, 337, 360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
)
LYNX = (
    269, 321, 585, 871, 1475, 2821, 3928, 5943, 4950, 2577, 523, 98, 184, 279, 409, 2285, 2685, 3409, 1824, 409, 151, 45, 68, 213, 546, 1033, 2129,
    2536, 957, 361, 377, 225, 360, 731, 1638, 2725, 2871, 2119, 684, 299, 236, 245, 552, 1623, 3311, 6721, 4254, 687, 255, 473, 358, 784, 1594, 1676,
    2251, 1426, 756, 299, 201, 229, 469, 736, 2042, 2811, 4431, 2511, 389, 73, 39, 49, 59, 188, 377, 1292, 4031, 3495, 587, 105, 153, 387, 758, 1307,
    3465, 6991, 6313, 3794, 1836, 345, 382, 808, 1388, 2713, 3800, 3091, 2985, 3790, 674, 81, 80, 108, 229, 399, 1132, 2432, 3574, 2935, 1537, 529,
    485, 662, 1000, 1590, 2657, 3396,
)
TEMPERATURE = (
    -0.17, -0.09, -0.11, -0.17, -0.28, -0.33, -0.31, -0.36, -0.17, -0.10, -0.35, -0.25, -0.30, -0.35, -0.31, -0.23, -0.11, -0.11, -0.27, -0.18, -0.08,
    -0.16, -0.28, -0.37, -0.47, -0.26, -0.22, -0.39, -0.43, -0.48, -0.43, -0.44, -0.36, -0.34, -0.15, -0.14, -0.36, -0.46, -0.30, -0.28, -0.27, -0.19,
    -0.28, -0.26, -0.24, -0.20, -0.11, -0.22, -0.20, -0.29, -0.18, -0.07, -0.14, -0.23, -0.17, -0.21, -0.09, 0.02, 0.06, 0.10, 0.02, 0.07, 0.04, 0.08,
    -0.01, 0.09, -0.07, -0.01, -0.07, -0.08, -0.16, -0.07, -0.01, 0.00, -0.05, -0.11, -0.06, -0.01, 0.01, 0.08, 0.02, 0.06, 0.05, 0.10, -0.20, -0.11,
    -0.06, -0.02, -0.08, 0.05, 0.03, 0.06, 0.02, 0.08, 0.14, -0.12, -0.07, -0.02, 0.04, 0.07, -0.02, 0.06, 0.06, 0.20, 0.05, -0.07, -0.01, 0.18, 0.07,
    0.17, 0.27, 0.32, 0.14, 0.31, 0.16, 0.12, 0.18, 0.32, 0.39, 0.27, 0.45, 0.41, 0.22, 0.23, 0.32, 0.45, 0.33, 0.46, 0.61, 0.39, 0.40, 0.54, 0.63,
    0.62, 0.54, 0.68, 0.64, 0.67, 0.54, 0.66, 0.72, 0.61, 0.65, 0.68,
)

#: name -> (value column, values or None if read from a path, first month end, months between).
CATALOGUE = {
    "nile": ("nile_flow", NILE, datetime.date(1871, 12, 31), 12),
    "airline": ("passengers", AIRLINE, datetime.date(1949, 1, 31), 1),
    "lynx": ("lynx_trappings", LYNX, datetime.date(1821, 12, 31), 12),
    "sunspots": ("sunspot_number", None, datetime.date(1700, 12, 31), 12),
    "temperature": ("temp_anomaly", TEMPERATURE, datetime.date(1880, 12, 31), 12),
    "gdp": ("gdp_growth", None, datetime.date(1947, 6, 30), 3),
}


def values(name: str, path: str | None = None) -> np.ndarray:
    """The series as an array of doubles."""
    stated = CATALOGUE[name][1]
    if stated is not None:
        return np.array(stated, float)
    if path is None:
        raise ValueError(f"{name}: the path of a file with one value a line is needed")
    return np.loadtxt(path, dtype=float, ndmin=1)


def load(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """(ts date, value column double), one row a period; dates are ends of months, quarters or years."""
    column, stated, first, months = CATALOGUE[name]
    if stated is None and path is None:
        raise ValueError(f"{name}: the path of a file with one value a line is needed")
    if stated is None:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda v: v != "")).alias("i", "v"))
        rows = lines.select("i", F.col("v").cast("double").alias(column))
    else:
        rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(stated)], f"i int, {column} double")
    return rows.select(F.last_day(F.add_months(F.lit(first), F.col("i") * months)).alias("ts"), column)


def load_nile(spark: SparkSession) -> DataFrame:
    return load(spark, "nile")


def load_airline(spark: SparkSession) -> DataFrame:
    return load(spark, "airline")


def load_lynx(spark: SparkSession) -> DataFrame:
    return load(spark, "lynx")


def load_temperature(spark: SparkSession) -> DataFrame:
    return load(spark, "temperature")


def load_sunspots(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "sunspots", path)


def load_gdp(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, "gdp", path)
