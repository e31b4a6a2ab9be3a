"""Helpers shared by the registered queries."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.plans.segments import attach  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded (and negative zero removed), so that both engines agree on the last digits."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name).cast("double"), special.get(name, digits)) + 0.0).alias(name))
        elif kind == "int" or kind == "smallint" or kind == "tinyint":
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def r(expression: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rounded``."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def stacked(columns: list[str], select: str) -> str:
    """UNION ALL of one SELECT per column; ``{c}`` stands for the column."""
    return " UNION ALL ".join(select.replace("{c}", c) for c in columns)


# Tail probabilities by Simpson's rule, for databases without distribution functions.
_PANELS = 4000


def _simpson(density: str, upper: str) -> str:
    weight = f"CASE WHEN i = 0 OR i = {_PANELS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    point = f"(({upper}) * i / {_PANELS}.0)"
    return (
        f"(SELECT sum({weight} * ({density.replace('{u}', point)})) * ({upper}) / {_PANELS}.0 / 3 "
        f"FROM range({_PANELS + 1}) AS g(i))"
    )


def t_tail(t: str, dof: str) -> str:
    """Two-sided p-value of t."""
    constant = f"exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi())"
    density = f"pow(1 + {{u}} * {{u}} / ({dof}), -(({dof}) + 1) / 2.0)"
    return f"greatest(0, 1 - 2 * {constant} * {_simpson(density, f'least(abs({t}), 40.0)')})"


def chi2_tail(x: str, dof: str) -> str:
    """Upper tail of chi-square, integrating over its square root."""
    constant = f"2 / (pow(2, ({dof}) / 2.0) * exp(lgamma(({dof}) / 2.0)))"
    density = f"pow({{u}}, ({dof}) - 1) * exp(-{{u}} * {{u}} / 2)"
    return f"greatest(0, 1 - {constant} * {_simpson(density, f'least(sqrt({x}), 60.0)')})"


def f_tail(f: str, dof1: str, dof2: str) -> str:
    """Upper tail of F, integrating over its square root."""
    a, b = f"(({dof1}) / 2.0)", f"(({dof2}) / 2.0)"
    constant = f"2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * pow(({dof1}) / CAST(({dof2}) AS DOUBLE), {a})"
    density = f"pow({{u}}, ({dof1}) - 1) * pow(1 + ({dof1}) * {{u}} * {{u}} / ({dof2}), -({a} + {b}))"
    return f"greatest(0, 1 - {constant} * {_simpson(density, f'least(sqrt({f}), 40.0)')})"
