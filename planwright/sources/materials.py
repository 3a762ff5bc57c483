"""The material library, the finishes that rooms start with, and the colour that shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fmt: off
#: Id, name, what it is offered for, colour.
MATERIALS = [
    ("paint-white", "White paint", ("wall", "ceiling", "trim", "door"), "#f4f3ef"), ("paint-cream", "Cream paint", ("wall", "ceiling"), "#efe6d2"), ("paint-beige", "Light beige paint", ("wall",), "#e3d5bf"), ("paint-gray", "Soft grey paint", ("wall",), "#c9cbcc"),
    ("paint-sage", "Sage accent", ("wall",), "#a8b59a"), ("paint-navy", "Navy accent", ("wall",), "#2f3d55"), ("paint-terracotta", "Terracotta accent", ("wall",), "#c0785a"), ("exterior-render", "Exterior render", ("wall",), "#d9d6cf"), ("wall-tile-ceramic", "Ceramic wall tile", ("wall",), "#f1f1ee"),
    ("floor-oak", "Oak", ("floor",), "#b7864f"), ("floor-light-oak", "Light oak", ("floor",), "#d4b48a"), ("floor-walnut", "Walnut", ("floor",), "#6e4a2f"), ("floor-herringbone", "Herringbone oak", ("floor",), "#c09463"), ("floor-tile", "Porcelain tile", ("floor",), "#d8d6d0"),
    ("floor-marble", "Marble", ("floor",), "#ecebe8"), ("floor-concrete", "Polished concrete", ("floor",), "#a9a8a4"), ("floor-carpet", "Carpet", ("floor",), "#bdb5a8"), ("floor-carpet-gray", "Grey carpet", ("floor",), "#8f9294"), ("floor-bath-tile", "Bathroom tile", ("floor",), "#c8ccd0"),
    ("floor-stone", "Stone", ("floor",), "#9c968c"), ("floor-decking", "Composite decking", ("floor",), "#7c6a58"), ("slab", "Structural slab", (), "#8d8a84"), ("ceiling-white", "White ceiling", ("ceiling",), "#fbfbf9"), ("ceiling-warm", "Warm white ceiling", ("ceiling",), "#f6efe2"),
    ("ceiling-wood", "Wood slat ceiling", ("ceiling",), "#b98d5f"), ("wood-oak", "Oak", ("door", "trim", "furniture"), "#b98a57"), ("wood-walnut", "Walnut", ("door", "trim", "furniture"), "#5f4029"), ("wood-white", "White painted wood", ("door", "trim", "furniture", "window"), "#f2f1ed"),
    ("wood-gray", "Grey painted wood", ("door", "trim", "furniture"), "#8e9294"), ("upvc-white", "White uPVC", ("window",), "#f5f5f3"), ("aluminium-dark", "Dark aluminium", ("window", "door"), "#3b3d40"), ("glass", "Glass", (), "#cfe3ee"), ("railing-glass", "Glass balustrade", (), "#b9d3df"),
    ("cabinet-white", "White cabinet", ("fixture", "furniture"), "#f0efeb"), ("cabinet-wood", "Wood cabinet", ("fixture", "furniture"), "#a77a4c"), ("cabinet-dark", "Dark cabinet", ("fixture", "furniture"), "#2f3134"), ("counter-marble", "Marble countertop", ("fixture",), "#eeedea"),
    ("counter-quartz", "Quartz countertop", ("fixture",), "#d9d7d2"), ("ceramic-white", "White ceramic", ("fixture",), "#fbfbfb"), ("steel", "Brushed steel", ("fixture", "furniture"), "#b4b7ba"), ("hob-black", "Black glass hob", ("fixture",), "#151617"), ("fabric-linen", "Linen", ("furniture",), "#b9ad9c"),
    ("fabric-sky", "Sky blue fabric", ("furniture",), "#8fd3ef"), ("fabric-rose", "Rose fabric", ("furniture",), "#efa9d6"), ("fabric-white", "White fabric", ("furniture",), "#f5f4f0"), ("fabric-slate", "Slate fabric", ("furniture",), "#cbd2d9"), ("fabric-charcoal", "Charcoal fabric", ("furniture",), "#4a4c50"),
    ("leaf-green", "Foliage", (), "#4f7a45"),
]
#: The finishes of a new room, and what differs by type.
BASE = {"wallMaterialId": "paint-white", "floorMaterialId": "floor-oak", "ceilingMaterialId": "ceiling-white", "trimMaterialId": "wood-white", "doorMaterialId": "wood-white", "windowMaterialId": "upvc-white", "lighting": "neutral"}
BY_TYPE = {
    ("bathroom", "toilet"): {"wallMaterialId": "wall-tile-ceramic", "floorMaterialId": "floor-bath-tile", "lighting": "cool"}, ("kitchen",): {"floorMaterialId": "floor-tile"}, ("bedroom",): {"floorMaterialId": "floor-carpet", "lighting": "warm"},
    ("balcony",): {"wallMaterialId": "exterior-render", "floorMaterialId": "floor-decking", "lighting": "off"}, ("storage", "utility"): {"floorMaterialId": "floor-carpet-gray", "lighting": "off"},
}
# fmt: on


def materials(spark: SparkSession) -> DataFrame:
    """One row per material: ord, material_id, name, uses, color."""
    return spark.createDataFrame([(i, k, n, list(u), c) for i, (k, n, u, c) in enumerate(MATERIALS)], "ord int, material_id string, name string, uses array<string>, color string")


def for_use(spark: SparkSession, use: str) -> DataFrame:
    """The materials offered for one use, in order."""
    return materials(spark).where(F.array_contains("uses", use))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def first_finishes(room_type: Column) -> Column:
    """The finishes that a room of a type starts with, as a map."""
    out = _map(BASE)
    for types, own in BY_TYPE.items():
        out = F.when(room_type.isin(*types), _map(BASE | own)).otherwise(out)
    return out


def shown_color(material_id: Column, override: Column) -> Column:
    """The colour that shows: the user's, else the material's."""
    return F.coalesce(override, _map({k: c for k, _, _, c in MATERIALS})[material_id])


def material_named(name: Column, use: str) -> Column:
    """The material for a use that an id or a name (in any case) means; the first of equals, or null."""
    out = F.lit(None).cast("string")
    for k, n, uses, _ in reversed(MATERIALS):
        if use in uses:
            out = F.when((name == k) | (F.lower(name) == n.lower()), k).otherwise(out)
    return out
