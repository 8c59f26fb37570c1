"""Production parameters that the queries and the pipeline share."""

from __future__ import annotations

SITE = "source"
TOXIC_FROM = 0.7
VOCABULARY = "word_bpe_49k.json"

# Sources are grouped to domains by their number; unlisted groups have weight 1.
MIX = {
    "levels": {
        "domain": "concat('d', cast(pmod(cast(regexp_extract(source, '([0-9]+)$', 1) as int), 4) as string))",
        "language": "lang",
        "source": "source",
    },
    "weights": {
        "domain": [("d0", 4.0), ("d1", 3.0), ("d2", 2.0), ("d3", 1.0)],
        "language": [("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0)],
    },
    "budget_share": 0.8,
    "max_epochs": 2,
    "seed": 7,
}

SHARDS = {"shards": 8, "seed": 7}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
