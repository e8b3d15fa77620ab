"""Sinks: CSV tables with fixed decimals, meshes as OBJ, PLY and STL, cached meshes as Parquet."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mesh import normal

FORMATS = ("obj", "ply", "stl")


def fixed(spec: str):
    """An Arrow UDF that prints doubles as C's printf does (the JVM rounds decimal ties otherwise); null gives nan."""
    line = f"%{spec}\n"

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        return pd.Series((line * len(values) % tuple(values)).split("\n")[:-1], index=values.index, dtype=object)  # a batch at a time

    return text


def csv_cells(df: DataFrame) -> DataFrame:
    """Doubles with three decimals, everything else as it is; null doubles come out as nan."""
    three = fixed(".3f")
    cells = {c: three(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(cells) if cells else df


def vertex_line(fmt: str, scalar: str | None = None) -> Column:
    """A vertex (x, y, z and the scalar column) as a line of an OBJ or PLY file."""
    six = fixed(".6f")
    xyz = F.concat_ws(" ", *(six(F.col(c)) for c in ("x", "y", "z", *([scalar] if scalar else []))))
    return F.concat(F.lit("v "), xyz) if fmt == "obj" else xyz


def face_line(fmt: str) -> Column:
    """A face (a, b, c from 0) as a line of an OBJ file, which counts from 1, or of a PLY file."""
    return F.concat_ws(" ", F.lit("f" if fmt == "obj" else "3"), *((F.col(c) + int(fmt == "obj")).cast("bigint").cast("string") for c in "abc"))


def facet_lines() -> Column:
    """A triangle ax .. cz as the lines of a facet of an STL file."""
    exp = fixed(".6e")
    parts = [F.concat(F.lit("  facet normal "), F.concat_ws(" ", *(exp(n) for n in normal()))), F.lit("    outer loop")]
    parts += [F.concat(F.lit("      vertex "), F.concat_ws(" ", *(exp(F.col(f"{c}{k}")) for k in "xyz"))) for c in "abc"]
    return F.array(*parts, F.lit("    endloop"), F.lit("  endfacet"))


def mesh_lines(vertices: DataFrame, faces: DataFrame, fmt: str, scalar: str | None = None, scalar_name: str = "scalar", title: str = "surface mesh") -> DataFrame:
    """Lines (section, id, part, line) of an ASCII mesh, to be written in that order.

    ``vertices``: vid from 0 without gaps, x, y, z and the ``scalar`` column (only for PLY). ``faces``: fid, a, b, c.
    An empty mesh and an unknown format are refused.
    """
    fmt = fmt.lower().strip()
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported mesh format: {fmt}")
    if scalar and fmt != "ply":
        raise ValueError("Per-vertex scalar export is only supported for PLY.")
    n_vertices, n_faces = vertices.count(), faces.count()
    if not n_vertices or not n_faces:
        raise ValueError("Mesh is empty; cannot export.")
    spark = vertices.sparkSession

    def rows(lines: list[str], section: int) -> DataFrame:
        return spark.createDataFrame([(section, i, 0, s) for i, s in enumerate(lines)], "section int, id bigint, part int, line string")

    def body(df: DataFrame, key: str, section: int, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(key).cast("bigint").alias("id"), F.lit(0).alias("part"), line.alias("line"))

    if fmt == "obj":
        return rows([f"# {title}"], 0).unionByName(body(vertices, "vid", 1, vertex_line(fmt))).unionByName(body(faces, "fid", 2, face_line(fmt)))
    if fmt == "ply":
        head = ["ply", "format ascii 1.0", f"comment {title}", f"element vertex {n_vertices}", *(f"property float {c}" for c in "xyz")]
        head += [f"property float {scalar_name}"] if scalar else []
        head += [f"element face {n_faces}", "property list uchar int vertex_indices", "end_header"]
        return rows(head, 0).unionByName(body(vertices, "vid", 1, vertex_line(fmt, scalar))).unionByName(body(faces, "fid", 2, face_line(fmt)))
    name = title.replace(" ", "_")
    t = faces
    for c in "abc":
        corner = vertices.select(F.col("vid").alias(c), *(F.col(k).alias(f"{c}{k}") for k in "xyz"))
        t = t.join(corner, c)
    facets = t.select(F.lit(1).alias("section"), F.col("fid").cast("bigint").alias("id"), F.posexplode(facet_lines()).alias("part", "line"))
    return rows([f"solid {name}"], 0).unionByName(facets).unionByName(rows([f"endsolid {name}"], 2))


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, fmt: str, **options) -> None:
    """The mesh's lines as ordered text parts under ``path``; the parts in their order are the file."""
    lines = mesh_lines(vertices, faces, fmt, **options)
    lines.orderBy("section", "id", "part").select("line").write.mode("overwrite").text(path)


def mesh_key(**parameters: object) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_triangles(spark: SparkSession, folder: str, build, **parameters: object) -> DataFrame:
    """Triangles read from ``folder`` if made with the same parameters before, else built and written there."""
    path = f"{folder}/{mesh_key(**parameters)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
