"""Feature encoding: kinds of columns, fitted transforms with inverses, one-hot and scaling."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC, BINARY, CATEGORY, TIME = "numerical", "boolean", "categorical", "datetime"


def kinds(df: DataFrame) -> dict[str, str]:
    """Integers of at most two values are boolean, other integers and texts categorical, fractions numerical; one pass for all columns."""
    whole = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")]
    n = df.agg(*(F.approx_count_distinct(c).alias(c) for c in whole)).first() if whole else {}
    out = {}
    for c, t in df.dtypes:
        if t == "boolean" or c in whole and n[c] <= 2:
            out[c] = BINARY
        elif t in ("double", "float") or t.startswith("decimal"):
            out[c] = NUMERIC
        elif t.startswith("timestamp") or t == "date":
            out[c] = TIME
        else:
            out[c] = CATEGORY
    return out


@dataclass
class Fitted:
    """One column's transform; to_json() and from_json() keep it."""

    column: str
    kind: str
    how: str
    numbers: dict[str, float] = field(default_factory=dict)
    values: list[str] = field(default_factory=list)

    def apply(self) -> list[Column]:
        c, n = F.col(self.column), self.numbers
        if self.kind == TIME:
            return [F.coalesce(F.unix_timestamp(c.cast("timestamp")).cast("double"), F.lit(n.get("fill", 0.0))).alias(self.column)]
        if self.kind == BINARY:
            return [F.coalesce(c.cast("int").cast("double"), F.lit(n.get("fill", 0.0))).alias(self.column)]
        if self.kind == NUMERIC:
            x = F.coalesce(c.cast("double"), F.lit(n["mean"]))
            if self.how == "minmax":
                span = n["max"] - n["min"]
                return [((x - n["min"]) / span if span else x * 0.0).alias(self.column)]
            return [((x - n["mean"]) / n["std"] if n["std"] else x - n["mean"]).alias(self.column)]
        if self.how == "onehot":
            return [F.coalesce((c.cast("string") == v).cast("int"), F.lit(0)).alias(f"{self.column}_{v}") for v in self.values]
        codes = F.create_map(*(x for i, v in enumerate(self.values) for x in (F.lit(v), F.lit(i)))) if self.values else F.create_map().cast("map<string,int>")
        return [F.try_element_at(codes, c.cast("string")).alias(self.column)]

    def invert(self) -> Column:
        c, n = F.col(self.column), self.numbers
        if self.kind == NUMERIC and self.how == "minmax":
            return (c * (n["max"] - n["min"]) + n["min"]).alias(self.column)
        if self.kind == NUMERIC:
            return (c * (n["std"] or 1.0) + n["mean"]).alias(self.column)
        if self.kind == TIME:
            return F.timestamp_seconds(c).alias(self.column)
        if self.kind == BINARY:
            return (c > 0.5).alias(self.column)
        if self.how == "onehot":
            hot = F.coalesce(*(F.when(F.col(f"{self.column}_{v}") == 1, v) for v in self.values))
            return hot.alias(self.column)
        return F.get(F.array(*(F.lit(v) for v in self.values)), c.cast("int")).alias(self.column)


class TableTransform:
    """Fits all columns in one pass over numbers and one over categories; applies and inverts as column expressions."""

    def __init__(self, override: dict[str, str] | None = None, numeric: str = "standard", category: str = "label", most_values: int = 10_000):
        self.override, self.numeric, self.category, self.most_values = override or {}, numeric, category, most_values
        self.fitted: list[Fitted] = []

    def fit(self, df: DataFrame) -> TableTransform:
        found = kinds(df) | self.override
        numbers = [c for c in df.columns if found[c] in (NUMERIC, TIME)]
        x = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double") if found[c] == TIME else F.col(c).cast("double")
        stats = df.agg(*(a for c in numbers for a in (F.avg(x(c)).alias(f"{c}|mean"), F.stddev_pop(x(c)).alias(f"{c}|std"), F.min(x(c)).alias(f"{c}|min"), F.max(x(c)).alias(f"{c}|max"))), F.lit(0).alias("_"), *(F.mode(F.col(c).cast("int")).alias(f"{c}|mode") for c in df.columns if found[c] == BINARY)).first()
        self.fitted = []
        for c in df.columns:
            kind = found[c]
            if kind in (NUMERIC, TIME):
                n = {k: float(stats[f"{c}|{k}"] or 0.0) for k in ("mean", "std", "min", "max")}
                self.fitted.append(Fitted(c, kind, self.numeric, n | {"fill": n["mean"]}))
            elif kind == BINARY:
                self.fitted.append(Fitted(c, kind, "mode", {"fill": float(stats[f"{c}|mode"] or 0.0)}))
            else:
                values = [r[0] for r in df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(self.most_values + 1).collect()]
                if len(values) > self.most_values:
                    raise ValueError(f"{c} has over {self.most_values} values; join a dictionary instead")
                self.fitted.append(Fitted(c, kind, self.category, {}, values))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*(x for f in self.fitted for x in f.apply()))

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.select(*(f.invert() for f in self.fitted))

    def to_json(self) -> str:
        return json.dumps([asdict(f) for f in self.fitted])

    @classmethod
    def from_json(cls, text: str) -> TableTransform:
        out = cls()
        out.fitted = [Fitted(**x) for x in json.loads(text)]
        return out


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column `<column>_<value>` for each value; other values give zeros everywhere."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the sample deviation; columns of no deviation stay."""
    s = df.agg(*(a for c in columns for a in (F.avg(c).alias(f"{c}|m"), F.stddev_samp(c).alias(f"{c}|d"))))
    joined = df.crossJoin(F.broadcast(s))
    return joined.select(*((F.when(F.col(f"`{c}|d`") > 0, (F.col(c) - F.col(f"`{c}|m`")) / F.col(f"`{c}|d`")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in df.columns))


def table_config(df: DataFrame, numeric: list[str], binary: list[str]) -> dict:
    """Roles of columns, with the number of values of each category."""
    rest = [c for c in df.columns if c not in numeric and c not in binary]
    n = df.agg(*(F.count_distinct(c).alias(c) for c in rest)).first().asDict() if rest else {}
    return {"numerical": [c for c in numeric if c in df.columns], "binary": [c for c in binary if c in df.columns], "categorical": rest, "cardinalities": n}


def demographic_columns(df: DataFrame, marks: tuple[str, ...] = ("gender", "age", "race", "ethnicity")) -> list[str]:
    return [c for c in df.columns if any(c.lower().startswith(f"{m}_") or c.lower() == m for m in marks)]


def example_mapping(trials: DataFrame, sites: DataFrame, trial: str, site: str, each: int = 3, seed: int = 42) -> DataFrame:
    """each sites for every trial, picked by hash: stands in where no mapping is given. For small tables."""
    from pyspark.sql import Window

    d = F.md5(F.concat(F.col(trial).cast("string"), F.lit(":"), F.col(site).cast("string"), F.lit(f":{seed}")))
    pairs = trials.select(trial).crossJoin(sites.select(site)).withColumn("__r", F.row_number().over(Window.partitionBy(trial).orderBy(d)))
    return pairs.where(F.col("__r") <= each).drop("__r")
