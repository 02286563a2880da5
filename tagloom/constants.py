"""Fixed values of the curation scheme.

They decide which rows match, so they are stated once, here, as plain text.
"""

# --- fixed values -------------------------------------------------------------------------------

# Values that mean "nothing recorded"; compared lower-cased and not trimmed.
NULL_MARKERS = (
    "missing",
    "not available",
    "not collected",
    "not applicable",
    "not provided",
    "not reported",
    "unknown",
)

# Cell texts that a default pandas CSV read turns into nulls.
TABLE_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fields that describe where a sample comes from, besides every field starting with "host".
SOURCE_FIELDS = (
    "isolation_source",
    "attribute_package",
    "ontological term",
    "IFSAC+ Category",
    "source_type",
    "sample_type",
    "culture_collection",
    "package",
    "attribute package",
    "IFSAC+ category",
    "food_origin",
    "disease",
)
# Prompts also mention the collector.
PROMPT_FIELDS = ("collected_by",) + SOURCE_FIELDS
FIELD_PREFIX = "host"

# Fields shown by the core projection of the attribute table.
CORE_FIELDS = ("geo_loc_name", "lat_lon", "collection_date", "host")

RECORD_ID_PREFIX = "SAMN"
SHARD_LENGTH = 8
BATCH_SIZE = 1000

PROMPT_HEAD = (
    "You will be given sample metadata. Classify the metadata into one of these host categories. "
    "Only use the categories given. Reply with the category only. Reply Not determined if unsure\n"
    "Host categories:\n"
)
PROMPT_SEPARATOR = "::"

UNKNOWN = "Unknown"

# Fields of a standardised record.
TARGET_FIELDS = (
    "title", "taxonomy_id", "owner", "owner_abbreviation", "model", "accession", "continent",
    "country", "region", "city", "potential_contaminant", "bioproject", "latitude", "longitude",
    "collected_by", "host", "isolation_source", "collection_date", "collection_year",
    "collection_month", "serotype", "publication date", "last_update", "submission_date", "id",
)

# Two-level scheme: niche -> allowed source types.
CATEGORY_SCHEME = {
    "Aquatic": ("Fish", "Marine Mammal", "Shellfish"),
    "Companion Animal": ("Canine", "Feline"),
    "Environment": ("Air", "Plant", "Soil/Dust", "Water"),
    "Feed": ("Animal Feed", "Meat"),
    "Food": ("Composite Food", "Dairy", "Fish", "Meat", "Shellfish"),
    "Human": ("Human",),
    "Laboratory": ("Laboratory",),
    "Livestock": ("Bovine", "Camelid", "Equine", "Ovine", "Swine"),
    "Poultry": ("Avian",),
    "Wild Animal": (
        "Amphibian", "Avian", "Bat", "Bovine", "Camelid", "Canine", "Deer", "Equine", "Feline",
        "Invertebrates", "Marsupial", "Other Mammal", "Ovine", "Primate", "Reptile", "Rodent",
        "Swine",
    ),
    "ND": ("ND",),
}

# Host names: (common name, scientific name); None where no scientific name applies.
HOST_NAMES = (
    ("Virginia opossum", "Didelphis virginiana"),
    ("Mountain horned dragon", "Acanthosaura capra"),
    ("Cuttlefish", "Sepia officinalis"),
    ("Common musk turtle", "Sternotherus odoratus"),
    ("Human (female)", "Homo sapiens"),
    ("Water", None),
    ("Hedgehog", "Erinaceus europaeus"),
    ("Eurasian wigeon", "Mareca penelope"),
    ("Domestic goat", "Capra hircus"),
    ("Turkey", "Meleagris gallopavo"),
    ("Domestic pig", "Sus scrofa domesticus"),
    ("Elephant seal", "Mirounga sp."),
    ("Spinach", "Spinacia oleracea"),
)

# Model settings.
TFIDF_MAX_FEATURES = 300
TFIDF_NGRAMS = (1, 3)
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.7
SAMPLE_SEED = 7
SPLIT_SEED = 76
SPLIT_TEST_SIZE = 0.25
CLUSTERS = 5
CLUSTER_SEED = 1
ELBOW_MAX_K = 30

# --- end of fixed values ------------------------------------------------------------------------

# A word is a run of letters, digits and underscores in any script; tokens have at least two
# characters. Written as Unicode classes because \w is ASCII-only in Java regular expressions.
WORD_CLASS = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = WORD_CLASS + "{2,}"

# Characters that Python's str.strip() removes.
STRIP_CHARACTERS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Spark's default English stop words (fixed values; not the same list as other libraries have).
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now i'll you'll
    he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
    doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
    how's let's ought that's there's what's when's where's who's why's would
    """.split()
)
