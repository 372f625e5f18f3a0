"""Biotope score: classes of surfaces, tree credits, coefficient sums over a parcel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def thickness_class(metres: Column, roof: Column | None = None) -> Column:
    """Substrate thickness to a class, by the ladder of roofs or of other structures; null stays null."""
    cm = metres * 100.0
    on_roof = F.when(cm < 20, "toiture_vegetalisee_extensive_substrat_moins_20cm").when(cm <= 50, "toiture_vegetalisee_simple_intensive_substrat_15_50cm").otherwise("toiture_vegetalisee_intensive_substrat_plus_50cm")
    other = (
        F.when(cm < 20, "toiture_vegetalisee_extensive_substrat_moins_20cm").when(cm <= 40, "vegetation_hors_sol_substrat_20_40cm").when(cm <= 80, "vegetation_hors_sol_substrat_41_80cm")
        .when(cm <= 150, "vegetation_hors_sol_substrat_81_150cm").otherwise("vegetation_hors_sol_substrat_plus_150cm")
    )
    ladder = other if roof is None else F.when(F.coalesce(roof, F.lit(False)), on_roof).otherwise(other)
    return F.when(metres.isNotNull(), ladder)


COLUMNS = {"bff_class": "string", "epaisseur_m": "double", "toiture": "boolean", "type_plui": "int", "layer": "string", "classe": "string", "n_arbres": "int", "forfait_arbre_m2": "double"}


def with_all_columns(rows: DataFrame) -> DataFrame:
    for name, kind in COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def resolve_class(rows: DataFrame, strict: bool = True) -> DataFrame:
    """bff_class by what a row states: class, thickness, planning type, layer (an unknown one is impermeable), land cover."""
    layers = _map({k: v[0] for k, v in dims.LAYERS.items()})
    by_layer = F.when(F.col("layer").isNotNull(), F.coalesce(layers[F.col("layer")], F.lit("surface_totalement_impermeable_sans_vegetation")))
    found = F.coalesce(F.col("bff_class"), thickness_class(F.col("epaisseur_m"), F.col("toiture")), _map(dims.PLUI_BFF)[F.col("type_plui")], by_layer, _map(dims.COSIA_BFF)[F.col("classe")])
    if strict:
        found = F.when(_map(dims.BFF)[found].isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no biotope class: "), F.coalesce(found, F.lit("nothing is stated")))))
    return rows.withColumn("bff_class", found)


def annotate(rows: DataFrame, strict: bool = True) -> DataFrame:
    """coef, credit (square metres of trees) and surface added; a row with a credit has no surface of its own."""
    rows = with_all_columns(rows)
    per_tree = _map({k: v[1] for k, v in dims.LAYERS.items() if v[1] is not None})[F.col("layer")]
    stated = F.col("n_arbres").isNotNull() & F.col("forfait_arbre_m2").isNotNull()
    credit = F.when(stated, F.col("n_arbres") * F.col("forfait_arbre_m2")).when(per_tree.isNotNull(), F.coalesce(F.col("n_arbres"), F.lit(1)) * per_tree).otherwise(0.0)
    rows = resolve_class(rows, strict).withColumn("credit", credit)
    return rows.withColumns({"coef": _map(dims.BFF)[F.col("bff_class")], "surface": F.when(F.col("credit") > 0, 0.0).otherwise(F.col("surface"))})


def by_class(annotated: DataFrame, *keys: str) -> DataFrame:
    """surface, credit and weighted area of each class."""
    per = annotated.groupBy(*keys, "bff_class").agg(F.sum("surface").alias("surface"), F.sum("credit").alias("credit"), F.first("coef").alias("coef"))
    return per.withColumn("ponderee", (F.col("surface") + F.col("credit")) * F.col("coef"))


def score(per_class: DataFrame, parcels: DataFrame, *keys: str) -> DataFrame:
    """cbs of every parcel (keys, parcel_area): 0 without surfaces, an error without an area."""
    total = per_class.groupBy(*keys).agg(F.sum("ponderee").alias("ponderee"))
    area = F.when(F.col("parcel_area") > 0, F.col("parcel_area")).otherwise(F.raise_error(F.lit("a parcel without area")).cast("double"))
    rows = parcels.join(total, list(keys), "left") if keys else parcels.crossJoin(F.broadcast(total))
    return rows.withColumn("cbs", F.coalesce(F.col("ponderee") / area, F.lit(0.0))).drop("ponderee")


def compare(existing: DataFrame, project: DataFrame, *keys: str) -> DataFrame:
    """Existing and project scores, their difference, and alert where the project is worse; null where one is unknown."""
    a, b = existing.select(*keys, F.col("cbs").alias("cbs_existant")), project.select(*keys, F.col("cbs").alias("cbs_projet"))
    if not keys:
        if max(a.limit(2).count(), b.limit(2).count()) > 1:
            raise ValueError("several scores and no keys to compare them by")
        a, b = a.withColumn("__one", F.lit(1)), b.withColumn("__one", F.lit(1))
    rows = a.join(b, list(keys) or ["__one"], "full").drop("__one")
    return rows.withColumns({"delta": F.col("cbs_projet") - F.col("cbs_existant"), "alert": F.col("cbs_projet") < F.col("cbs_existant")})


def class_shares(rows: DataFrame, name: str = "classe", surface: str = "surface") -> DataFrame:
    """Area and per cent of each class; the total is one row, joined as such."""
    per = rows.groupBy(name).agg(F.sum(surface).alias("area"))
    return per.crossJoin(F.broadcast(rows.agg(F.sum(surface).alias("__all")))).withColumn("pct", 100.0 * F.col("area") / F.col("__all")).drop("__all")


def overlay_by_weight(cells: DataFrame) -> DataFrame:
    """Cells (row, col, layer, weight, ord): the layer of greatest weight keeps a cell, the earlier one on ties."""
    return cells.groupBy("row", "col").agg(F.max_by("layer", F.struct("weight", -F.col("ord"))).alias("layer"))
