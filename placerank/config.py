"""Fixed domain values: attribute list, day names, ordinal codes, request defaults."""

# Fixed values: (attribute, value when a pool has no data for it, weight in the score).
# The order is the order of the vector.
ATTRIBUTES = [
    ("GoodForDancing", 0, 2),
    ("DogsAllowed", 0, 3),
    ("WheelchairAccessible", 0, 5),
    ("NoiseLevel", 1, 4),
    ("RestaurantsAttire", 0, 3),
    ("ByAppointmentOnly", 0, 2),
    ("RestaurantsGoodForGroups", 1, 4),
    ("RestaurantsReservations", 0, 3),
    ("OutdoorSeating", 0, 3),
    ("GoodForKids", 0, 4),
    ("RestaurantsDelivery", 0, 2),
    ("RestaurantsTakeOut", 1, 3),
    ("RestaurantsPriceRange2", 2, 5),
    ("BusinessAcceptsCreditCards", 1, 4),
    ("Ambience_romantic", 0, 3),
    ("Ambience_intimate", 0, 3),
    ("Ambience_touristy", 0, 2),
    ("Ambience_hipster", 0, 2),
    ("Ambience_divey", 0, 2),
    ("Ambience_classy", 0, 3),
    ("Ambience_trendy", 0, 3),
    ("Ambience_upscale", 0, 3),
    ("Ambience_casual", 0, 3),
]
ATTRIBUTE_NAMES = [name for name, _, _ in ATTRIBUTES]
DEFAULTS = [float(default) for _, default, _ in ATTRIBUTES]
IMPORTANCE = [float(weight) for _, _, weight in ATTRIBUTES]

AMBIENCES = [n.removeprefix("Ambience_") for n in ATTRIBUTE_NAMES if n.startswith("Ambience_")]
# Codes of the ordinal attributes.
ORDINALS = {
    "NoiseLevel": {"quiet": 0, "average": 1, "loud": 2, "very_loud": 3},
    "RestaurantsAttire": {"casual": 0, "dressy": 1, "formal": 2},
}
PRICE = "RestaurantsPriceRange2"
TRISTATES = [
    n for n in ATTRIBUTE_NAMES
    if n not in ORDINALS and n != PRICE and not n.startswith("Ambience_")
]
# Fields promoted out of the raw `attributes` struct.
RAW_ATTRIBUTES = [n for n in ATTRIBUTE_NAMES if not n.startswith("Ambience_")] + ["Ambience"]

# Names of days in order, kinds of compliments, the Earth's mean radius.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

COMPLIMENTS = [
    "hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos",
]

EARTH_KM = 6371.0

# Bounds of what a query may ask for: larger ones are rejected with a reason, as one answer has to stay small.
MAX_SCOPE, MAX_RESULTS = 1000, 10_000

# What a request means when a field is missing.
HOME_LATITUDE, HOME_LONGITUDE, HOME_NAME = 27.9483, -82.4648, "User"
REQUEST_DEFAULTS = {
    "locality_mode": "radial", "state": "FL", "city": "Tampa", "radius": 5.0,
    "categories": "Bars, Nightlife", "day": "Friday", "time_minutes": 1260, "scope": 5, "n": 5,
    "currently_open": True, "recommend_reviewed": False, "trip_duration": False, "detail": False,
}

# Word2Vec training settings for category lists.
W2V = dict(minCount=10, vectorSize=100, maxIter=5, windowSize=3, seed=2)
