"""Parameters of the registered queries: languages of the data, weights, gates and plans."""

WEIGHTS = {"en": 1, "fr": 2, "de": 2, "es": 3}
VOCAB_SIZE = 10_000
SUPERWORDS = 32
PENALTY_LANG = "fr"
CEILINGS = {"en": 1.15, "fr": 1.3, "de": 1.4, "es": 1.3}
# Most tokens a word by language.
NATIVE_CEILINGS = {
    "en": 1.15, "hi": 1.30, "bn": 1.80, "mr": 1.70, "te": 1.95, "ta": 2.20, "ur": 1.50, "gu": 1.85, "kn": 2.25, "ml": 2.35, "or": 1.75, "pa": 1.45,
    "as": 1.95, "ne": 1.70, "mai": 1.65, "doi": 1.50, "kok": 2.25, "sa": 2.70, "ks": 1.35, "sd": 1.55, "brx": 2.15, "mni": 2.40, "sat": 3.00,
}
SALT = "granary"
