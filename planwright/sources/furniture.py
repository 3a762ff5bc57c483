"""The furniture catalogue as a small table, with search and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Materials offered for covers and for woods, and groups of room types.
FABRICS = ("fabric-linen", "fabric-sky", "fabric-rose", "fabric-white", "fabric-slate", "fabric-charcoal")
WOODS = ("wood-oak", "wood-walnut", "wood-white", "wood-gray")
LIVING, BED = ("living", "kitchen-living"), ("bedroom",)

# fmt: off
#: Id, name, category, (width, depth, height), keywords, material, materials, against a wall, preferred wall,
#: clearance in front, collides, room types, resize range as factors.
ITEMS = [
    ("armchair", "Armchair", "armchair", (0.85, 0.85, 0.85), ("chair", "accent chair", "lounge chair"), "fabric-linen", FABRICS, False, "any", 0.45, True, (*LIVING, "bedroom"), (0.7, 1.4)),
    ("sofa-3", "3-seat sofa", "sofa", (2.2, 0.9, 0.85), ("sofa", "couch", "settee", "three seat", "3 seat", "3-seater", "three seater"), "fabric-linen", FABRICS, True, "longest", 0.6, True, LIVING, (0.7, 1.4)),
    ("sofa-2", "2-seat sofa", "sofa", (1.6, 0.88, 0.85), ("loveseat", "two seat", "2 seat", "2-seater", "small sofa"), "fabric-linen", FABRICS, True, "longest", 0.6, True, LIVING, (0.7, 1.4)),
    ("bed-king", "King-size bed", "bed", (1.6, 2.1, 1.05), ("king bed", "king size", "kingsize"), "fabric-white", FABRICS, True, "longest", 0.6, True, BED, (0.9, 1.1)),
    ("bed-double", "Double bed", "bed", (1.45, 2.05, 1.0), ("bed", "double"), "fabric-white", FABRICS, True, "longest", 0.6, True, BED, (0.9, 1.1)),
    ("bed-single", "Single bed", "bed", (1.0, 2.0, 0.9), ("single", "kids bed"), "fabric-white", FABRICS, True, "any", 0.6, True, BED, (0.9, 1.1)),
    ("bedside-table", "Bedside table", "bedside-table", (0.45, 0.4, 0.55), ("nightstand", "bedside"), "wood-oak", WOODS, True, "any", 0.0, True, BED, (0.7, 1.4)),
    ("dining-table-4", "Dining table (4)", "dining-table", (1.2, 0.8, 0.75), ("dining table", "table", "kitchen table"), "wood-oak", WOODS, False, "any", 0.75, True, (*LIVING, "dining", "kitchen"), (0.7, 1.4)),
    ("dining-table-6", "Dining table (6)", "dining-table", (1.8, 0.9, 0.75), ("large dining table", "six seat table"), "wood-walnut", WOODS, False, "any", 0.75, True, (*LIVING, "dining"), (0.7, 1.4)),
    ("dining-chair", "Dining chair", "dining-chair", (0.45, 0.5, 0.85), ("chair", "kitchen chair"), "wood-oak", WOODS, False, "any", 0.0, True, (*LIVING, "dining", "kitchen"), (0.7, 1.4)),
    ("coffee-table", "Coffee table", "coffee-table", (1.1, 0.6, 0.42), ("coffee", "low table"), "wood-oak", WOODS, False, "any", 0.0, True, LIVING, (0.7, 1.4)),
    ("tv-unit", "TV unit", "tv-unit", (1.6, 0.42, 0.5), ("tv", "television", "media unit", "tv stand", "media console"), "wood-walnut", WOODS, True, "any", 1.5, True, (*LIVING, "bedroom"), (0.7, 1.4)),
    ("wardrobe", "Wardrobe", "wardrobe", (1.0, 0.6, 2.0), ("closet", "armoire"), "wood-white", WOODS, True, "any", 0.7, True, BED, (0.5, 2.0)),
    ("desk", "Desk", "desk", (1.2, 0.6, 0.75), ("work desk", "study desk", "office"), "wood-oak", WOODS, True, "any", 0.8, True, ("bedroom", *LIVING), (0.7, 1.4)),
    ("office-chair", "Office chair", "office-chair", (0.6, 0.6, 1.0), ("desk chair", "task chair"), "fabric-charcoal", FABRICS, False, "any", 0.0, True, ("bedroom", *LIVING), (0.7, 1.4)),
    ("bookshelf", "Bookshelf", "bookshelf", (0.8, 0.32, 1.8), ("bookcase", "shelves", "shelf"), "wood-oak", WOODS, True, "any", 0.5, True, (), (0.7, 1.4)),
    ("sideboard", "Sideboard", "cabinet", (1.5, 0.45, 0.8), ("cabinet", "buffet", "credenza", "chest of drawers", "drawers"), "wood-walnut", WOODS, True, "any", 0.6, True, (), (0.7, 1.4)),
    ("rug", "Rug", "rug", (2.0, 1.4, 0.01), ("carpet", "mat"), "fabric-slate", FABRICS, False, "any", 0.0, False, (), (0.5, 1.8)),
    ("floor-lamp", "Floor lamp", "lamp", (0.35, 0.35, 1.6), ("lamp", "standing lamp", "reading lamp"), "steel", ("steel", "wood-oak", "wood-walnut"), False, "any", 0.0, True, (), (0.7, 1.4)),
    ("plant", "Plant", "plant", (0.45, 0.45, 1.2), ("plant", "pot plant", "houseplant", "greenery"), "leaf-green", ("leaf-green",), False, "any", 0.0, True, (), (0.7, 1.4)),
]
# fmt: on
SIZE = "struct<width:double,depth:double,height:double>"
SCHEMA = f"ord int, catalog_id string, name string, category string, size {SIZE}, keywords array<string>, material_id string, material_options array<string>, against_wall boolean, prefer_wall string, front_clearance double, collides boolean, room_types array<string>, least {SIZE}, most {SIZE}"


def catalog(spark: SparkSession) -> DataFrame:
    """One row per item, with the sizes between which it may be resized."""
    rows = []
    for i, (key, name, kind, size, words, material, materials, wall, prefer, front, collides, rooms, (low, high)) in enumerate(ITEMS):
        rows.append((i, key, name, kind, size, list(words), material, list(materials), wall, prefer, front, collides, list(rooms), *(tuple(round(v * k, 2) for v in size) for k in (low, high))))
    return spark.createDataFrame(rows, SCHEMA)


def searched(asked: DataFrame, query: str = "query") -> DataFrame:
    """The items each query means, in the catalogue's order: (the columns of ``asked``, catalog_id).

    A query is held by an item's name, category or a keyword, or holds a keyword; an empty one means all.
    """
    q = F.trim(F.lower(F.col(query)))
    entries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r[0]).alias("catalog_id"), F.lit(r[1].lower()).alias("name"), F.lit(r[2]).alias("category"), F.array(*map(F.lit, r[4])).alias("keywords")) for i, r in enumerate(ITEMS)])
    meant = lambda e: F.contains(e["name"], q) | F.contains(e["category"], q) | F.exists(e["keywords"], lambda k: F.contains(k, q) | F.contains(q, k))
    return asked.select("*", F.explode(F.filter(entries, meant)).alias("e")).select(*asked.columns, F.col("e.catalog_id").alias("catalog_id"))


def with_rules(furniture: DataFrame, items: DataFrame) -> DataFrame:
    """Placed furniture with its item's ``collides`` and ``front_clearance``; an unknown item collides and needs no room."""
    rules = F.broadcast(items.select("catalog_id", "collides", "front_clearance"))
    return furniture.join(rules, "catalog_id", "left").fillna(True, ["collides"]).fillna(0.0, ["front_clearance"])
