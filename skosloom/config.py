"""Settings, with the defaults of the concept-hierarchy pipeline."""

from __future__ import annotations

from dataclasses import dataclass

# The stop words that results depend on.
STOP_WORDS = (
    "à", "de", "du", "des", "le", "la", "les", "un", "une", "et", "ou", "pour", "avec", "sans", "sur", "sous",
    "dans", "par", "en", "au", "aux", "ce", "cette", "ces", "d", "l", "qu", "que", "qui", "dont", "où", "si", "mais",
    "car", "donc", "or", "ni", "soit", "comme", "entre", "vers", "chez", "depuis", "pendant", "après", "avant", "selon", "malgré",
    "iii", "jacques", "musical", "majeur", "petit", "anciens", "règle", "étranger", "regard", "simple", "paul", "jour",
    "compassion", "plusieurs", "editeur", "relations", "non", "mineur", "pierre", "haute", "plein", "grand", "grande", "baptiste",
    "fonds", "piece", "cadence", "chasse", "jean", "contre", "fragment", "tragi",
)

# The adjectives that results depend on.
ADJECTIVES = (
    "musical", "musicale", "musicaux", "musicales", "sonore", "sonores", "vocal", "vocale", "vocaux", "vocales", "instrumental", "instrumentale",
    "instrumentaux", "instrumentales", "choral", "chorale", "choraux", "chorales", "symphonique", "symphoniques", "lyrique", "lyriques",
    "opératique", "opératiques", "sacré", "sacrée", "sacrés", "sacrées", "profane", "profanes", "traditionnel", "traditionnelle", "traditionnels",
    "traditionnelles", "populaire", "populaires", "classique", "classiques", "contemporain", "contemporaine", "contemporains", "contemporaines",
    "ancien", "ancienne", "anciens", "anciennes", "moderne", "modernes", "majeur", "majeure", "majeurs", "majeures", "mineur", "mineure",
    "mineurs", "mineures", "folklorique", "folkloriques", "jazz", "rock", "électronique", "électroniques", "numérique", "numériques", "digitale",
    "digitales", "digital", "digitals", "acoustique", "acoustiques",
)

# The suffixes stripped from a word, the first that fits.
SUFFIXES = ("tion", "ment", "able", "ique", "eur", "euse", "ant", "ent")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the pipeline; every operator takes what it needs from here."""

    uri_base: str = "http://example.org/vocabulary/"
    min_label_term_frequency: int = 2
    min_word_frequency: int = 3
    min_word_length: int = 3
    min_substring_length: int = 4
    similarity_threshold: float = 0.6
    prefix_threshold: float = 0.5
    min_family_size: int = 2
    pattern_min_frequency: int = 3
    zone_threshold: float = 0.75
    analogy_threshold: float = 0.70
    abstract_threshold: float = 0.65
    family_threshold: float = 0.60
    context_words: int = 50
    max_parents: int = 3
    acceptance: float = 0.8
    max_path_edges: int = 5
    review_default: str = "S"


DEFAULTS = Settings()
