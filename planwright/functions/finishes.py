"""Words for finishes, styles and rooms in sentences, and what they stand for."""

from __future__ import annotations

#: Patterns of floor, wall and ceiling finishes and of light, the first that fits.
FLOOR_WORDS = (
    ("herringbone|parquet", "floor-herringbone"), ("light oak|pale wood|light wood", "floor-light-oak"), ("walnut|dark wood", "floor-walnut"), ("marble", "floor-marble"), ("concrete", "floor-concrete"),
    ("grey carpet|gray carpet", "floor-carpet-gray"), ("carpet", "floor-carpet"), (r"porcelain|tiles?\b", "floor-tile"), ("stone|slate", "floor-stone"), ("oak|wood|timber|hardwood|laminate", "floor-oak"),
)
WALL_WORDS = (
    ("light beige|beige|sand|taupe", "paint-beige"), ("cream|ivory|off[- ]white|magnolia", "paint-cream"), ("grey|gray", "paint-gray"), ("sage|green", "paint-sage"), ("navy|blue", "paint-navy"),
    ("terracotta|orange|rust", "paint-terracotta"), (r"tiles?\b|tiled", "wall-tile-ceramic"), ("white", "paint-white"),
)
CEILING_WORDS = (("wood|timber|slat", "ceiling-wood"), ("warm", "ceiling-warm"), ("white", "ceiling-white"))
LIGHT_WORDS = (
    ("warm (light|lighting|glow)|cosy light|cozy light", "warm"), ("cool (light|lighting)|daylight bulbs?|bright (light|lighting)", "cool"), ("neutral (light|lighting)", "neutral"), ("lights? off|turn off the lights?", "off"),
)
#: Patterns of the surfaces that a clause may be about: floor, walls, ceiling.
SUBJECTS = (r"\bfloor(ing|s)?\b", r"\bwalls?\b|\bpaint(ed)?\b", r"\bceilings?\b")
#: Styles: id, name, keywords, finishes of dry rooms, other finishes of wet rooms.
PRESETS = (
    ("scandinavian", "Scandinavian", ("scandinavian", "scandi", "nordic", "hygge"),
     {"wallMaterialId": "paint-white", "floorMaterialId": "floor-light-oak", "ceilingMaterialId": "ceiling-white", "doorMaterialId": "wood-white", "lighting": "warm"}, {"wallMaterialId": "wall-tile-ceramic", "floorMaterialId": "floor-tile"}),
    ("warm-modern", "Warm modern", ("warm", "cosy", "cozy", "modern", "walnut"),
     {"wallMaterialId": "paint-beige", "floorMaterialId": "floor-walnut", "ceilingMaterialId": "ceiling-warm", "doorMaterialId": "wood-oak", "lighting": "warm"}, {"floorMaterialId": "floor-stone"}),
    ("industrial", "Industrial", ("industrial", "loft", "concrete", "urban"),
     {"wallMaterialId": "paint-gray", "floorMaterialId": "floor-concrete", "doorMaterialId": "wood-gray", "windowMaterialId": "aluminium-dark", "lighting": "neutral"}, {"floorMaterialId": "floor-concrete"}),
    ("classic-luxe", "Classic luxe", ("luxury", "luxe", "classic", "elegant", "herringbone", "parisian"),
     {"wallMaterialId": "paint-cream", "floorMaterialId": "floor-herringbone", "ceilingMaterialId": "ceiling-warm", "doorMaterialId": "wood-white", "lighting": "warm"}, {"floorMaterialId": "floor-marble", "wallMaterialId": "wall-tile-ceramic"}),
    ("bright-airy", "Bright & airy", ("larger", "bigger", "spacious", "bright", "airy", "light", "open"),
     {"wallMaterialId": "paint-white", "floorMaterialId": "floor-light-oak", "ceilingMaterialId": "ceiling-white", "lighting": "cool"}, {"floorMaterialId": "floor-tile"}),
)
#: Names of kinds of rooms with the types that they mean, in order of trial.
TYPE_ALIASES = (
    ("living room", ("living", "kitchen-living")), ("lounge", ("living", "kitchen-living")), ("sitting room", ("living", "kitchen-living")), ("living area", ("living", "kitchen-living")), ("open plan", ("kitchen-living",)), ("open-plan", ("kitchen-living",)),
    ("kitchen", ("kitchen", "kitchen-living")), ("diner", ("dining", "kitchen-living")), ("dining room", ("dining", "kitchen-living")), ("dining area", ("dining", "kitchen-living")), ("bathroom", ("bathroom",)), ("toilet", ("toilet", "bathroom")),
    ("hallway", ("hall",)), ("corridor", ("hall",)), ("hall", ("hall",)), ("entrance", ("hall",)), ("balcony", ("balcony",)), ("terrace", ("balcony",)),
)
#: Numbers in words, and the nouns that belong to a mention before them.
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "pair": 2}
NOUNS = "(?:sofa|couch|bed|table|chair|unit|lamp|desk|shelf|wardrobe)s?"
ORDINALS = {"1": 1, "one": 1, "2": 2, "two": 2, "3": 3, "three": 3}
#: Patterns of bedrooms, of all rooms, and of what a sentence asks for.
BEDROOM = r"\b(master|main|largest|biggest|big|smallest|small|second|first|third|spare)?\s*bed\s?room\s*(\d|one|two|three)?\b"
EVERYWHERE = r"\b(all rooms|every room|everywhere|whole (flat|apartment|place)|entire (flat|apartment))\b"
QUESTION = r"\b(can|could|will|would|does|do|is there)\b[^.]*\bfit\b|\broom for\b"
REMOVAL = r"\b(remove|delete|get rid of|take out|clear)\b"
CHANGE = r"\b(renovate|redecorate|refurbish|redo|repaint|paint|make|style|look|feel|replace|change|switch)\b"
FINISH = r"\b(floor|flooring|walls?|paint|ceiling|style|look|feel|scandinavian|scandi|industrial|luxe|luxury|modern|larger|bigger|brighter|light(ing)?)\b"
SURFACE = r"\b(floor|flooring|walls?|ceiling)\b"
DESCRIPTION = r"\b(describe|tell me about|how big|what('s| is) the (size|area))\b"
PLACING = r"\b(put|place|add|fit|furnish|insert|want|need|get|arrange|move in)\b"
LONGEST_WALL = r"\blongest wall\b"
