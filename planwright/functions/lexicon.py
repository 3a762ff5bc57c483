"""Vocabulary of room labels and other fixed words of plan text."""

from __future__ import annotations

import unicodedata

#: Fixed values: (upper-case ASCII word, room type, shown name where it isn't the word itself, weight where it isn't 1).
LEXICON: list[tuple[str, str, str | None, float]] = [
    # bedrooms
    ("BEDROOM", "bedroom", None, 1), ("BED", "bedroom", "Bedroom", 1), ("BEDRM", "bedroom", "Bedroom", 1), ("BDRM", "bedroom", "Bedroom", 1),
    ("BR", "bedroom", "Bedroom", 0.7), ("MASTER", "bedroom", "Master Bedroom", 1), ("SLEEPOUT", "bedroom", None, 0.7), ("NURSERY", "bedroom", None, 1),
    ("CHAMBRE", "bedroom", None, 1), ("SCHLAFZIMMER", "bedroom", None, 1), ("KINDERZIMMER", "bedroom", None, 1), ("ZIMMER", "bedroom", None, 0.45),
    ("DORMITORIO", "bedroom", None, 1), ("HABITACION", "bedroom", None, 0.7), ("SLAAPKAMER", "bedroom", None, 1),
    # living
    ("LIVING", "living", None, 1), ("LOUNGE", "living", None, 1), ("RECEPTION", "living", None, 1), ("SITTING", "living", None, 1),
    ("FAMILY", "living", None, 0.8), ("SALON", "living", None, 1), ("SEJOUR", "living", None, 1), ("WOHNZIMMER", "living", None, 1),
    ("WOHNEN", "living", None, 1), ("SALA", "living", None, 0.8), ("ESTAR", "living", None, 1), ("SOGGIORNO", "living", None, 1), ("WOONKAMER", "living", None, 1),
    # kitchens
    ("KITCHEN", "kitchen", None, 1), ("KITCHENETTE", "kitchen", None, 1), ("KIT", "kitchen", "Kitchen", 0.8), ("KITCH", "kitchen", "Kitchen", 1),
    ("CUISINE", "kitchen", None, 1), ("KUCHE", "kitchen", "Küche", 1), ("KUECHE", "kitchen", "Küche", 1), ("COCINA", "kitchen", None, 1),
    ("CUCINA", "kitchen", None, 1), ("KEUKEN", "kitchen", None, 1),
    # dining
    ("DINING", "dining", None, 1), ("DINER", "dining", None, 1), ("ESSZIMMER", "dining", None, 1), ("ESSEN", "dining", None, 0.8), ("COMEDOR", "dining", None, 1),
    # bathrooms and toilets
    ("BATHROOM", "bathroom", None, 1), ("BATH", "bathroom", "Bathroom", 1), ("SHOWER", "bathroom", None, 1), ("ENSUITE", "bathroom", None, 1),
    ("EN-SUITE", "bathroom", None, 1), ("T&B", "bathroom", "Bathroom", 1), ("WASHROOM", "bathroom", None, 0.8), ("BAD", "bathroom", "Bad", 0.8),
    ("BADEZIMMER", "bathroom", None, 1), ("SDB", "bathroom", "Salle de bains", 1), ("BANO", "bathroom", "Baño", 1), ("BAGNO", "bathroom", None, 1),
    ("BADKAMER", "bathroom", None, 1), ("WC", "toilet", "WC", 1), ("W.C.", "toilet", "WC", 1), ("TOILET", "toilet", None, 1), ("TOILETS", "toilet", "Toilet", 1),
    ("TOILETTES", "toilet", None, 1), ("LAVATORY", "toilet", None, 1), ("CLOAKROOM", "toilet", None, 1), ("CLOAKS", "toilet", "Cloakroom", 1), ("POWDER", "toilet", "Powder Room", 1),
    # halls
    ("HALL", "hall", None, 1), ("HALLWAY", "hall", None, 1), ("ENTRANCE", "hall", None, 1), ("ENTRY", "hall", None, 1), ("LANDING", "hall", None, 1),
    ("CORRIDOR", "hall", None, 1), ("LOBBY", "hall", None, 1), ("FOYER", "hall", None, 1), ("PASSAGE", "hall", None, 1), ("VESTIBULE", "hall", None, 1),
    ("FLUR", "hall", None, 1), ("DIELE", "hall", None, 1), ("ENTREE", "hall", "Entrée", 1), ("PASILLO", "hall", None, 1), ("RECIBIDOR", "hall", None, 1),
    ("INGRESSO", "hall", None, 1), ("GANG", "hall", None, 0.7),
    # outdoors
    ("BALCONY", "balcony", None, 1), ("TERRACE", "balcony", None, 1), ("LOGGIA", "balcony", None, 1), ("BALKON", "balcony", None, 1),
    ("TERRASSE", "balcony", None, 1), ("BALCON", "balcony", None, 1), ("TERRAZA", "balcony", None, 1), ("VERANDA", "balcony", None, 1),
    # utility and storage
    ("UTILITY", "utility", None, 1), ("LAUNDRY", "utility", None, 1), ("WD", "utility", "Laundry", 0.8), ("BOILER", "utility", None, 1),
    ("BUANDERIE", "utility", None, 1), ("HAUSWIRTSCHAFT", "utility", None, 1), ("LAVANDERIA", "utility", None, 1),
    ("STORE", "storage", None, 1), ("STORAGE", "storage", None, 1), ("CUPBOARD", "storage", None, 1), ("CPD", "storage", "Cupboard", 1), ("CLOSET", "storage", None, 1),
    ("CLOS", "storage", "Closet", 1), ("WARDROBE", "storage", None, 1), ("WIC", "storage", "Walk-in Closet", 1), ("PANTRY", "storage", None, 1),
    ("LINEN", "storage", None, 1), ("AIRING", "storage", None, 1), ("KAMMER", "storage", None, 0.7), ("ABSTELLRAUM", "storage", None, 1),
    ("RANGEMENT", "storage", None, 1), ("PLACARD", "storage", None, 1), ("TRASTERO", "storage", None, 1),
    # rooms without a type of their own
    ("STUDY", "unknown", None, 1), ("OFFICE", "unknown", None, 1), ("DEN", "unknown", None, 1), ("LIBRARY", "unknown", None, 1), ("GARAGE", "unknown", None, 1),
    ("CARPORT", "unknown", None, 1), ("PORCH", "unknown", None, 1), ("STAIRS", "unknown", None, 1), ("STAIRCASE", "unknown", None, 1),
    ("TREPPENHAUS", "unknown", None, 1), ("ARBEITSZIMMER", "unknown", None, 1), ("BUREAU", "unknown", None, 1),
]
#: Characters that readers of scans take for letters.
ALPHA_CONFUSIONS = {"0": "O", "1": "I", "5": "S", "8": "B", "6": "G", "|": "I"}
#: Types of rooms that one label names together.
COMBINED_TYPES = {"kitchen+living": "kitchen-living", "kitchen+dining": "kitchen-living", "kitchen+living+dining": "kitchen-living", "dining+living": "living", "bathroom+toilet": "bathroom"}
#: Words beside a room's name that change nothing.
NEUTRAL_WORDS = ("ROOM", "RM", "AREA", "MAIN", "PRINCIPAL", "GUEST", "OPEN", "PLAN", "SMALL", "LARGE", "DOUBLE", "SINGLE", "WALK", "IN", "NO", "THE", "AND", "DE", "DU", "LA", "LE", "SALLE", "MAIDS", "MAID")
#: Types that may share one open space.
OPEN_PLAN = ("kitchen", "living", "dining", "kitchen-living")
#: The types of rooms.
ROOM_TYPES = ("living", "kitchen", "kitchen-living", "dining", "bedroom", "bathroom", "toilet", "hall", "balcony", "utility", "storage", "unknown")


def accents() -> tuple[str, str]:
    """Latin letters with accents and their base letters, by Unicode decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, b) for c, b in pairs if b != c and b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)
