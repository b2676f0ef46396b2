"""Rules, lexicon and other parameters suited to the given test tables.

The default rules name airport topics, of which the test tables say nothing, so
the registered queries use words that occur in them.
"""

from ..operators.cleaning import NAME_PATTERN
from ..operators.engagement import SatisfactionLimits
from ..operators.filters import Filters
from ..operators.sentiment import Modifiers

TOPICS = (("Navigation", ("click", "view")), ("Conversion", ("purchase",)))
TOPIC_DEFAULT = "Other"
TOPIC_NAMES = ("Navigation", "Conversion", "Other")

INTENTS = (
    ("booking", ("reserve", "book")),
    ("pricing", ("price", "cost")),
    ("hours", ("hour", "open")),
    ("menu", ("that", "menu")),
    ("cancellation", ("ing", "refund")),
)
INTENT_DEFAULT = "other"

LEXICON = (
    ("click", 0.4), ("view", 0.1), ("purchase", 2.4), ("signup", -0.9), ("error", -1.8),
    ("that", 1.1), ("with", -0.8), ("for", 0.7), ("this", 1.9), ("from", -1.5),
    ("die", -1.2), ("und", -0.6), ("les", 0.4), ("des", -0.3), ("was", 1.3), ("er", -2.1),
    ("le", 0.8),
)
MODIFIERS = Modifiers(
    negations=("not", "no", "ne", "as", "un"),
    strengtheners=("very", "so", "the", "le"),
    weakeners=("hardly", "of", "la", "der"),
    never=("never", "de", "to"),
    so=("so", "la", "the"),
    without=("un", "not"),
    doubt=("doubt", "le", "the"),
    least=("least", "and", "et"),
    before_least=("at", "in", "de"),
    unweighted_pairs=("kind of", "that the"),
    weakening_pairs=("sort of", "of the", "de la", "in the"),
    idioms=(("for the", 1.2), ("with the", -0.8), ("the that", 0.9), ("to the", 1.5), ("in the this", 2.0), ("of the", -1.1)),
)

STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "as",
    "by", "this", "are", "at", "an", "from", "he", "or",
)

CANDIDATES = (
    ("Support", ("error", "help", "that")),
    ("Conversion", ("purchase", "the")),
    ("Information", ("information", "with", "from the")),
    ("Billing", ("cost", "price", "und")),
    ("Account", ("login", "account")),
    ("Integration", ("api", "sync", "tion")),
)

LIMITS = SatisfactionLimits(
    high_turns=40, high_response_sec=100_000, high_session=1.03,
    low_turns=30, low_response_sec=140_000, low_session=1.0,
)

FILTERS = Filters(
    "2024-01-05", "2024-01-20", topics=("Navigation", "Other"), sentiments=("positive", "negative")
)
USER_FILTERS = Filters("2024-01-02", "2024-01-28", users=("Customer#000000003", "Customer#000000007", "Customer#000000011", "Nobody"))

CLEANING = {
    "supplier": (("drop", "s_acctbal"), ("rename", {"s_suppkey": "supplier_id"})),
    "customer": (
        ("drop", "c_acctbal", "c_mktsegment"),
        ("rename", {"c_custkey": "client_id", "c_name": "name"}),
    ),
    "part": (
        ("drop", "p_retailprice"),
        ("rename", {"p_partkey": "part_id"}),
        ("delete_unmatched", "part_id", "p_name", NAME_PATTERN),
        ("delete_short", "part_id", "p_type", 5),
        ("delete_values", "part_id", "p_brand", ("Brand#2", "Brand#17")),
    ),
}

CUSTOM_QUERY = (
    "SELECT c.client_id, c.name, count(m.question) AS questions FROM clients c "
    "LEFT JOIN chats m ON m.client_id = c.client_id GROUP BY c.client_id, c.name "
    "HAVING count(m.question) > 10"
)
