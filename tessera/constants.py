"""Fixed values.

Everything in this module must equal the behaviour being reproduced (thresholds, weights,
label text, lookup tables). They are stated plainly, in their natural order, and used as
*defaults* of operator parameters — every operator accepts overrides.
"""

# --------------------------------------------------------------------------------------
# FIXED VALUES — must match the reproduced behaviour exactly
# --------------------------------------------------------------------------------------

# id scan: ids per batch, ids per request, empty batches in a row that end a scan
SCAN_BATCH_SIZE = 20
SCAN_CHUNK_SIZE = 10
MAX_CONSECUTIVE_EMPTY = 50

# quality filter
MIN_NUM_RATES = 20
MIN_AVG_RATING = 6.0

# popularity score weights (owned, wished, number of ratings, average rating / 10)
POPULARITY_WEIGHTS = {
    "owned_by": 0.35,
    "wished_by": 0.25,
    "num_rates": 0.20,
    "avg_rating": 0.20,
}

# language dependence phrase -> encoded level (unmapped values pass through unchanged)
LANGUAGE_DEPENDENCY_MAPPING = {
    "No necessary in-game text": "none",
    "Some necessary text - easily memorized or small crib sheet": "low",
    "Moderate in-game text - needs crib sheet or paste ups": "medium",
    "Extensive use of text - massive conversion needed to be playable": "high",
    "Unplayable in another language": "extreme",
}

# category groups: group name -> lower-cased member categories
CATEGORY_GROUPS = {
    "time_period_historical": [
        "ancient", "medieval", "renaissance", "age of reason", "american west", "arabian",
        "napoleonic", "post-napoleonic", "prehistoric",
    ],
    "military_conflict": [
        "world war i", "world war ii", "korean war", "vietnam war", "modern warfare",
        "american revolutionary war", "american civil war", "civil war", "american indian wars",
        "pike and shot", "wargame",
    ],
    "based_on_media": [
        "movies / tv / radio theme", "video game theme", "book", "novel-based",
        "comic book / strip", "music",
    ],
    "crime_espionage": ["murder / mystery", "spies / secret agents", "mafia"],
    "fantasy_supernatural": ["fantasy", "science fiction", "mythology", "zombies", "pirates"],
    "horror": ["horror"],
    "resource_management": [
        "economic", "industry / manufacturing", "farming", "city building", "civilization",
        "territory building",
    ],
    "card_game": ["card game"],
    "physical_components": ["dice", "miniatures", "collectible components"],
    "print_and_play": ["print & play"],
    "memory": ["memory"],
    "trivia": ["trivia"],
    "deduction": ["deduction"],
    "vehicles_movement": ["aviation / flight", "trains", "transportation", "racing"],
    "negotiation": ["negotiation", "bluffing"],
    "mental_skill": ["educational", "math", "number", "word game", "puzzle"],
    "social_entertainment": ["party game", "children's game", "humor", "mature / adult"],
    "journey_discovery": [
        "adventure", "exploration", "travel", "maze", "nautical", "space exploration",
    ],
    "real_world_topics": ["religious", "political", "environmental", "animals"],
    "sports": ["sports"],
    "fighting": ["fighting"],
    "abstract_strategy": ["abstract strategy"],
    "real_time": ["real-time"],
    "action_dexterity": ["action / dexterity"],
    "game_system": ["game system"],
    "electronic": ["electronic"],
}

# bucket rules: (upper bound inclusive, label); values above the last bound are
# "Unknown" (dropped) unless an open-ended label is given
AGE_BUCKETS = [(8, "Kids"), (12, "Family"), (16, "Teen")]
AGE_OPEN_LABEL = "Adult"
DURATION_BUCKETS = [(30, "Short"), (60, "Medium"), (120, "Long")]
DURATION_OPEN_LABEL = "Very_Long"
DIFFICULTY_BUCKETS = [(1, "Very Easy"), (2, "Easy"), (3, "Medium"), (4, "Hard"), (5, "Very_Hard")]
DIFFICULTY_OPEN_LABEL = None
UNKNOWN_BUCKET = "Unknown"

# one-hot prefixes used by the preparation pipeline
AGE_PREFIX = "AGE_GROUP"
DURATION_PREFIX = "GAME_DURATION"
DIFFICULTY_PREFIX = "GAME_DIFFICULTY"
CATEGORY_PREFIX = "GAME_CAT"
CATEGORY_GROUP_PREFIX = "GAME_CAT_GROUP"
LANGUAGE_PREFIX = "LANGUAGE_DEPENDENCY"
GROUP_SIZE_PREFIX = "GROUP_SIZE"

# feature-column prefixes, in this order
FEATURE_PREFIXES = ["AGE_GROUP", "GAME_CAT", "LANGUAGE_DEPENDENCY", "GAME_DURATION", "GAME_DIFFICULTY"]

# default constraint column for constrained clustering
CONSTRAINT_COLUMNS = ["GAME_CAT_GROUP_card_game"]

# recommendation score weights and similarity cut
REC_POPULARITY_WEIGHT = 0.25
REC_DISTANCE_WEIGHT = 0.55
REC_RATING_QUALITY_WEIGHT = 0.20
MAX_NORMALIZED_DISTANCE = 0.4
TOP_K = 5
WILSON_Z = 1.96

# explanation phrases and thresholds
EXPLAIN_VERY_SIMILAR = "This game is very similar to your selected game"
EXPLAIN_MANY_SHARED = "This game shares many characteristics with your selected game"
EXPLAIN_SOME_SHARED = "This game has some similarities to your selected game"
EXPLAIN_POPULAR = "it's also popular among board game enthusiasts"
EXPLAIN_WELL_RATED = "it's well-rated by the community"
EXPLAIN_SIM_THRESHOLDS = (0.8, 0.6, 0.4)
EXPLAIN_SECONDARY_THRESHOLD = 0.7
EXPLAIN_JOINER = " and "

# recommendation status messages ({} = input name)
STATUS_OK = "ok"
STATUS_NOT_IN_CLUSTER = "Game '{}' not found in any cluster"
STATUS_NO_OTHER = "No other games found in the same cluster"
STATUS_NONE_IN_FRAME = "No candidate games found in the dataframe"
STATUS_NONE_SIMILAR = "No games similar enough to '{}' were found"

# k selection
KMEANS_SEED = 42
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
KMEANS_TOL = 1e-4
SILHOUETTE_WEIGHT = 0.65
SIZE_WEIGHT = 0.35
COMPLEXITY_PENALTY = 0.1

# cluster description text
DESC_TOP_FEATURES = 5
DESC_SAMPLE = 5
DESC_LABEL_REPLACEMENTS = [
    ("GAME_CAT_GROUP_", ""),
    ("AGE_GROUP_", ""),
    ("LANGUAGE_DEPENDENCY_", "language: "),
    ("GAME_DURATION_", "duration: "),
    ("GAME_DIFFICULTY_", "difficulty: "),
    ("_", " "),
]

# basket binning
BIN_THRESHOLD = 0.7

# snapshots
SNAPSHOT_DATE_FORMAT = "yyyyMMdd"
STALE_AFTER_DAYS = 7

# feedback log columns, in order
FEEDBACK_COLUMNS = ["timestamp", "input_game", "recommended_game", "feedback", "reason", "comment"]

# raw item schema: (column, Spark SQL type), in order
RAW_ITEM_COLUMNS = [
    ("game_name", "string"),
    ("description", "string"),
    ("subcategory_1", "string"),
    ("subcategory_2", "string"),
    ("publication_year", "int"),
    ("min_players", "int"),
    ("max_players", "int"),
    ("best_num_players", "string"),
    ("recommended_num_players", "string"),
    ("suggested_play_age", "int"),
    ("categories", "array<string>"),
    ("mechanics", "array<string>"),
    ("families", "array<string>"),
    ("designers", "array<string>"),
    ("artists", "array<string>"),
    ("publishers", "array<string>"),
    ("playing_time", "int"),
    ("min_playtime", "int"),
    ("max_playtime", "int"),
    ("min_age", "int"),
    ("language_dependence_description", "string"),
    ("game_rank", "int"),
    ("avg_rating", "double"),
    ("num_rates", "int"),
    ("rank_subcategory_1", "int"),
    ("rank_subcategory_2", "int"),
    ("avg_weight", "double"),
    ("num_weights", "int"),
    ("owned_by", "int"),
    ("wished_by", "int"),
]

# nested record: link types, in output order
LINK_TYPES = [
    ("categories", "boardgamecategory"),
    ("mechanics", "boardgamemechanic"),
    ("families", "boardgamefamily"),
    ("designers", "boardgamedesigner"),
    ("artists", "boardgameartist"),
    ("publishers", "boardgamepublisher"),
]
POLL_PLAYERS = "suggested_numplayers"
POLL_AGE = "suggested_playerage"
POLL_LANGUAGE = "language_dependence"
POLL_BEST = "Best"
POLL_RECOMMENDED = "Recommended"
AGE_21_PLUS_LABEL = "21 and up"
AGE_21_PLUS_VALUE = 21
RANK_OVERALL_NAME = "boardgame"
RANK_FAMILY_TYPE = "family"
NOT_RANKED = "Not Ranked"
