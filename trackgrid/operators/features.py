"""Classification of vector features by ordered attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes of a feature in the order in which they are tried.
ATTRIBUTES = ("class", "subtype", "type", "kind", "landuse", "landcover")
#: Half widths of roads in metres by class, that of other classes, and classes that are no roads.
ROAD_M = {
    "motorway": 7.0, "trunk": 6.0, "primary": 5.0, "secondary": 4.0, "tertiary": 3.5, "residential": 3.0,
    "unclassified": 2.5, "living_street": 2.0, "service": 2.0, "track": 1.5, "path": 1.0, "driveway": 1.5,
    "parking_aisle": 2.0, "pedestrian": 1.5, "runway": 25.0, "taxiway": 12.0,
}
OTHER_ROAD_M, NO_ROADS, BUILDING_M = 2.5, ("footway", "steps", "cycleway", "sidewalk"), 1.5
#: Land tags of the seven-class scheme and the codes that they lead to.
FOREST = ("land_cover:forest", "land_cover:wood")
FARMLAND = ("land_use:farmland", "land_use:agriculture", "land_use:crop", "land_use:cropland", "land_use:horticulture", "land_use:meadow")
BUILT_UP = ("land_use:residential", "land_use:commercial", "land_use:industrial", "land_use:retail", "land_use:education", "land_use:institutional")
FOREST_CODE, FARMLAND_CODE = 200, 300


def classify_features(layer: Column, attrs: Column, rules: dict[str, int]) -> Column:
    """Class id of a feature: for each attribute in order `layer:value`, then `layer.attr:value`; else `layer:*`; else 0."""
    table = F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k, v)]) if rules else F.create_map().cast("map<string,int>")
    tries = []
    for a in ATTRIBUTES:
        value = F.lower(F.trim(attrs[a]))
        tries += [table[F.concat(layer, F.lit(":"), value)], table[F.concat(layer, F.lit(f".{a}:"), value)]]
    return F.coalesce(*tries, table[F.concat(layer, F.lit(":*"))], F.lit(0))


def classify_features_v7(layer: Column, attrs: Column, water: int, roads: int, built_up: int) -> Column:
    """Seven-class scheme: direct classes as 100 + id, forest and farmland as codes of their own; else null."""
    tags = [F.concat(layer, F.lit(":"), F.lower(attrs[a])) for a in ("class", "subtype", "type", "kind", "landcover", "landuse")]
    code = lambda t: F.when(t.isin(*FOREST), FOREST_CODE).when(t.isin(*FARMLAND), FARMLAND_CODE).when(t.isin(*BUILT_UP), 100 + built_up)
    land = F.when(layer.isin("land_cover", "land_use"), F.coalesce(*[code(t) for t in tags]))
    return F.when(layer == "water", 100 + water).when(layer == "transportation", 100 + roads).otherwise(land)


def road_widths(roads: DataFrame, cls: str = "class") -> DataFrame:
    """Roads without footpaths, with width_m by class."""
    name = F.lower(F.coalesce(F.col(cls), F.lit("")))
    table = F.create_map(*[F.lit(x) for k, v in ROAD_M.items() for x in (k, v)])
    return roads.filter(~name.isin(*NO_ROADS)).withColumn("width_m", F.coalesce(table[name], F.lit(OTHER_ROAD_M)))


def valid_kinds(features: DataFrame) -> DataFrame:
    """Polygons of all layers, and lines of the transport layer."""
    area = F.col("kind").isin("Polygon", "MultiPolygon")
    line = F.col("kind").isin("LineString", "MultiLineString") & (F.col("layer") == "transportation")
    return features.filter(area | line)


def remap_classes(cells: DataFrame, mapping: dict[int, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v)])
    return cells.withColumn("v", F.coalesce(table[F.col("v").cast("int")], F.lit(0)))


def stable_classes(cells: DataFrame, schema: DataFrame, height: int, crop_top: float = 0.0) -> DataFrame:
    """Classes that the schema (id, stable) calls stable; others, and the top share of rows, become 0."""
    flags = schema.select(F.col("id").alias("v"), "stable")
    keep = F.coalesce(F.col("stable"), F.lit(False)) & (F.col("r") >= int(height * crop_top))
    return cells.join(flags, "v", "left").withColumn("v", F.when(keep, F.col("v")).otherwise(0)).drop("stable")
