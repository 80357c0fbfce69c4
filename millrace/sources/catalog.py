"""A catalog of typed tables: schemas by name, and loaders from CSV or Parquet folders."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.predicates import Predicate
from millrace.sources.tables import read_csv, schema

Attributes = list[tuple[str, str]]

#: The tables of the Join Order Benchmark's movie database and the order of their columns after `id`.
_MOVIES = """
aka_name: person_id name imdb_index name_pcode_cf name_pcode_nf surname_pcode md5sum
aka_title: movie_id title imdb_index kind_id production_year phonetic_code episode_of_id season_nr episode_nr note md5sum
cast_info: person_id movie_id person_role_id note nr_order role_id
char_name: name imdb_index imdb_id name_pcode_nf surname_pcode md5sum
comp_cast_type: kind
company_name: name country_code imdb_id name_pcode_nf name_pcode_sf md5sum
company_type: kind
complete_cast: movie_id subject_id status_id
info_type: info
keyword: keyword phonetic_code
kind_type: kind
link_type: link
movie_companies: movie_id company_id company_type_id note
movie_info: movie_id info_type_id info note
movie_info_idx: movie_id info_type_id info note
movie_keyword: movie_id keyword_id
movie_link: movie_id linked_movie_id link_type_id
name: name imdb_index imdb_id gender name_pcode_cf name_pcode_nf surname_pcode md5sum
person_info: person_id info_type_id info note
role_type: role
title: title imdb_index kind_id production_year imdb_id phonetic_code episode_of_id season_nr episode_nr series_years md5sum
"""
#: Columns of whole numbers beside those whose names end in _id, _nr or _year.
_NUMBERS = frozenset({"id", "nr_order", "episode_of_id"})


def _kind(column: str) -> str:
    return "INT32" if column in _NUMBERS or column.endswith(("_id", "_nr", "_year")) else "VARCHAR"


def movie_tables() -> dict[str, Attributes]:
    """The 21 tables of the workload."""
    out = {}
    for line in _MOVIES.split("\n"):
        if line:
            name, columns = line.split(": ")
            out[name] = [(c, _kind(c)) for c in ("id", *columns.split())]
    return out


@dataclass
class Catalog:
    """Tables by name. path: a folder with NAME.csv or NAME.parquet (files or folders) for each."""

    path: str
    tables: dict[str, Attributes] = field(default_factory=movie_tables)
    kind: str = "csv"

    def columns(self) -> dict[str, list[str]]:
        return {t: [c for c, _ in a] for t, a in self.tables.items()}

    def load(self, spark: SparkSession, name: str, where: Predicate | None = None) -> DataFrame:
        """The typed table. No schema is inferred; a Parquet file with other columns or types fails."""
        if name not in self.tables:
            raise KeyError(f"the catalog has no table {name}")
        if self.kind == "csv":
            return read_csv(spark, f"{self.path}/{name}.csv", self.tables[name], where)
        df = spark.read.parquet(f"{self.path}/{name}.parquet")
        want = schema(self.tables[name])
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
            raise ValueError(f"{name}: found {df.schema.simpleString()}, the catalog has {want.simpleString()}")
        return df.filter(where.compile(lambda c: df[c])) if where is not None else df

    def register(self, spark: SparkSession, names: list[str] | None = None) -> dict[str, DataFrame]:
        """Views of the tables, and the tables."""
        out = {name: self.load(spark, name) for name in names or self.tables}
        for name, df in out.items():
            df.createOrReplaceTempView(name)
        return out

    def to_parquet(self, spark: SparkSession, path: str) -> Catalog:
        """Writes every table once as Parquet, and the catalog of these."""
        for name in self.tables:
            self.load(spark, name).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        return Catalog(path, self.tables, "parquet")


def read_sql_file(folder: str, name: str) -> str:
    return (Path(folder) / f"{name}.sql").read_text()
