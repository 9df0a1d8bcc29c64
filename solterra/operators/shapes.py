"""Footprints, catalogs, grids, features and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import rest
from ..functions import text
from .rows import boxes_touch

#: Weight of building types in the rank of importance (fixed values).
WEIGHTS = {
    "tower": 10.0, "skyscraper": 10.0, "office": 5.0, "commercial": 4.0, "hospital": 4.0, "school": 3.0, "residential": 2.0, "apartments": 2.0,
    "house": 1.0, "garage": 0.5, "shed": 0.2,
}

FEATURES = "struct<type:string,features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
CATALOG = "tileId string, id string, minLon double, minLat double, maxLon double, maxLat double, region string, description string"


def importance(area: Column, height: Column, kind: Column, name: Column) -> Column:
    """Root of the area times height over ten, by the type's weight (1 for others), half more for a name that isn't empty."""
    table = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    weight = F.coalesce(F.try_element_at(table, kind), F.lit(1.0))
    return F.sqrt(area) * height * 0.1 * weight * F.when(F.coalesce(name, F.lit("")) != "", 1.5).otherwise(1.0)


def ranked(buildings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """buildings (building_id, area, height, kind, name) with importance and rank from 1; ties by id."""
    scored = buildings.withColumn("importance", importance(F.col("area"), F.col("height"), F.col("kind"), F.col("name")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc("importance"), "building_id")))


def kept_at_zoom(buildings: DataFrame, count: int, min_area: float, min_height: float, small: bool) -> DataFrame:
    """The ``count`` most important buildings, and of those the ones of ``min_area`` and ``min_height`` or more; without
    ``small`` those below 100 m² go too. A null area or height counts as 0. The cut comes first, as a top-k sort."""
    scored = buildings.withColumn("importance", F.coalesce(importance(F.col("area"), F.col("height"), F.col("kind"), F.col("name")), F.lit(0.0)))
    area, height = F.coalesce("area", F.lit(0.0)), F.coalesce("height", F.lit(0.0))
    top = scored.orderBy(F.desc("importance"), "building_id").limit(count)
    return top.where((area >= min_area) & (height >= min_height) & (F.lit(small) | (area >= 100)))


def partitions_of(tiles: DataFrame, size_deg: float, prefix: str = "p") -> DataFrame:
    """tiles (tile_id, west, south, east, north, more) cut into rectangles of ``size_deg`` from their south-west corner, the
    last ones clipped at the tile's edge: partition_id and min_lon .. max_lat with the tile's columns. Tiles without width
    or height give none."""
    steps = lambda a, b: F.sequence(F.lit(0).cast("long"), F.ceil((b - a - 1e-12) / size_deg) - 1)
    cut = tiles.where("west < east and south < north").withColumn("_i", F.explode(steps(F.col("west"), F.col("east")))).withColumn("_j", F.explode(steps(F.col("south"), F.col("north"))))
    low = lambda c, k: F.round(F.col(c) + F.col(k) * size_deg, 10)
    cut = cut.withColumn("min_lon", low("west", "_i")).withColumn("min_lat", low("south", "_j"))
    cut = cut.withColumn("max_lon", F.least("east", F.round(F.col("min_lon") + size_deg, 10))).withColumn("max_lat", F.least("north", F.round(F.col("min_lat") + size_deg, 10)))
    name = text.partition_id(prefix, F.lit(size_deg), *map(F.col, ("min_lon", "min_lat", "max_lon", "max_lat")))
    return cut.select(name.alias("partition_id"), *(c for c in tiles.columns if c not in ("west", "south", "east", "north")), "min_lon", "min_lat", "max_lon", "max_lat")


def refined(partitions: DataFrame, hot: DataFrame, size_deg: float, prefix: str = "h") -> DataFrame:
    """Finer rectangles inside the partitions that ``hot`` (partition_id) names: partition_id, parent_id and bounds."""
    parents = partitions.join(hot.select("partition_id").distinct(), "partition_id", "left_semi")
    tiles = parents.select(F.col("partition_id").alias("parent_id"), F.col("min_lon").alias("west"), F.col("min_lat").alias("south"), F.col("max_lon").alias("east"), F.col("max_lat").alias("north"))
    return partitions_of(tiles, size_deg, prefix)


def sample_grid(boxes: DataFrame, n: int, most: int = 50) -> DataFrame:
    """boxes (west, south, east, north, more) with the points (lon, lat) of an inner grid of n by n, n held to 3..``most``:
    the box's edges hold none."""
    k = max(3, min(n, most))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * F.col(i) / (k + 1)
    steps = F.explode(F.sequence(F.lit(1), F.lit(k)))
    return boxes.withColumn("i", steps).withColumn("j", steps).withColumn("lon", at("west", "east", "i")).withColumn("lat", at("south", "north", "j"))


def read_features(documents: DataFrame, column: str) -> DataFrame:
    """documents with a row for each feature of a FeatureCollection in JSON: position, geometry_type, coordinates (JSON) and
    props (map<string,string>, empty where there are none). Text that is none gives no rows."""
    parsed = documents.withColumn("_f", F.from_json(column, FEATURES))
    rows = parsed.select(*(c for c in documents.columns if c != column), F.posexplode("_f.features").alias("position", "_x"))
    props = F.coalesce("_x.properties", F.create_map().cast("map<string,string>"))
    return rows.select(*(c for c in rows.columns if c != "_x"), F.col("_x.geometry.type").alias("geometry_type"), F.col("_x.geometry.coordinates").alias("coordinates"), props.alias("props"))


def first_property(props: Column, *names: str) -> Column:
    """The first of the named properties that is there."""
    return F.coalesce(*(F.try_element_at(props, F.lit(n)) for n in names))


def build_features(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, features): a FeatureCollection in JSON of the points lon, lat of each group with their other columns as properties,
    in the order given. A group is one document, so it meets in one task: for map tiles and the like."""
    props = [c for c in rows.columns if c not in (*by, "lon", "lat")]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(*props).alias("properties")
    )
    listed = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, feature.alias("f")))), lambda x: x.f).alias("f"))
    return listed.select(*by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("f").alias("features"))).alias("features"))


def catalog(rows: DataFrame) -> DataFrame:
    """(tile_id, west, south, east, north, region, description) of rows of a catalog (see CATALOG), the id under either of its
    names. Rows without id or corner make the job fail: a catalog with holes is an error."""
    out = rows.select(F.coalesce("tileId", "id").alias("tile_id"), F.col("minLon").alias("west"), F.col("minLat").alias("south"), F.col("maxLon").alias("east"), F.col("maxLat").alias("north"), "region", "description")
    whole = F.lit(True)
    for c in ("tile_id", "west", "south", "east", "north"):
        whole = whole & F.col(c).isNotNull()
    return out.withColumn("tile_id", F.when(whole, F.col("tile_id")).otherwise(F.raise_error(F.lit("a catalog entry lacks its id or a corner"))))


def polygons_of(multi: DataFrame, column: str) -> DataFrame:
    """A row for each polygon (array of rings) of a multipolygon (array of polygons); part counts from 0. Empty polygons go."""
    rows = multi.select(*(c for c in multi.columns if c != column), F.posexplode(column).alias("part", column))
    return rows.where(F.size(column) > 0)


def in_box(buildings: DataFrame, west: float, south: float, east: float, north: float, most: int | None = None) -> DataFrame:
    """Buildings (x0, x1, y0, y1, more) whose bounds touch the box, edges included; the first ``most`` by building_id."""
    box = boxes_touch((F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), tuple(map(F.lit, (west, south, east, north))))
    out = buildings.where(box)
    return out if most is None else out.orderBy("building_id").limit(most)


def with_vertex_in(buildings: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Buildings of which a vertex of ``ring`` lies in the box, edges included."""
    return buildings.where(F.exists("ring", lambda p: p.x.between(west, east) & p.y.between(south, north)))


def near_points(buildings: DataFrame, points: DataFrame, margin: float, cell: float) -> DataFrame:
    """Buildings (building_id, x0 .. y1) that touch the square of ``margin`` around any point (x, y), each once: an equi-join
    on grid cells of ``cell``, then the exact test. Points of one cell are counted once before the join."""
    at = lambda c: F.floor(c / cell)
    covered = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    spots = points.where("x is not null and y is not null").select("x", "y").distinct()
    p = spots.withColumn("_x", covered(F.col("x") - margin, F.col("x") + margin)).withColumn("_y", covered(F.col("y") - margin, F.col("y") + margin))
    b = buildings.withColumn("_x", covered(F.col("x0"), F.col("x1"))).withColumn("_y", covered(F.col("y0"), F.col("y1")))
    square = (F.col("x") - margin, F.col("y") - margin, F.col("x") + margin, F.col("y") + margin)
    met = b.join(p, ["_x", "_y"]).where(boxes_touch((F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), square)).select("building_id").distinct()
    return buildings.join(met, "building_id", "left_semi")


def downsampled(pixels: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel (r, c, value) both ways, numbered anew; a step of 1 or less keeps all."""
    k = max(1, step)
    return pixels.where((F.col("r") % k == 0) & (F.col("c") % k == 0)).withColumn("r", F.floor(F.col("r") / k)).withColumn("c", F.floor(F.col("c") / k))


def step_for(rows: int, columns: int, most: int) -> int:
    """The least step at which a raster has ``most`` pixels at most."""
    k = 1
    while -(-rows // k) * -(-columns // k) > most:
        k += 1
    return k


def raster_components(pixels: DataFrame, threshold: float, rounds: int = 200) -> DataFrame:
    """(r, c, value, component, height) of the pixels of ``threshold`` or more: component is the least r * 2^32 + c of those
    that hang together by their sides, height its largest value. Labels halve their way by pointer jumps: each round takes the
    least label of the neighbours, then the label's own label; rounds rest in checkpoints. Null and NaN pixels are none."""
    kept = pixels.where((F.col("value") >= threshold) & ~F.isnan("value")).groupBy("r", "c").agg(F.max("value").alias("value"))
    label = lambda r, c: r.cast("long") * (1 << 32) + c.cast("long")
    now = rest(kept.withColumn("id", label(F.col("r"), F.col("c"))).withColumn("component", F.col("id")))
    for _ in range(rounds):
        beside = F.explode(F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)))))
        told = now.select("component", beside.alias("at")).groupBy("at.r", "at.c").agg(F.min("component").alias("least"))
        met = now.join(told, ["r", "c"])
        hop = met.select(F.col("id").alias("least"), F.col("least").alias("further"))
        after = rest(met.join(hop, "least", "left").select("r", "c", "value", "id", F.least("least", F.coalesce("further", "least")).alias("component"), (F.col("least") < F.col("component")).alias("_moved")))
        moved = not after.where("_moved").isEmpty()
        now = after.drop("_moved")
        if not moved:
            break
    else:
        raise RuntimeError("raster components did not settle")
    tall = now.groupBy("component").agg(F.max("value").alias("height"))
    return now.join(tall, "component").select("r", "c", "value", "component", "height")
