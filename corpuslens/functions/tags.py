"""Part-of-speech tags from closed word classes and suffix rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Closed-class words by fine tag. The words win over the suffix rules.
TAG_WORDS = {
    "CC": "and but or nor yet plus",
    "PRP": "me we us you he him she her it they them myself yourself himself herself itself "
    "ourselves yourselves themselves hers ours yours theirs mine",
    "PRP$": "my your his its our their",
    "WP": "who whom what",
    "WP$": "whose",
    "IN": "of in on at by for with from about into over after before between under during "
    "without within against through because if while although though since until as than that",
    "DT": "an the this these those each every some any all both another",
    "TO": "to",
    "CD": "one two three four five six seven eight nine ten",
    "MD": "can could will would shall should may might must",
    "VB": "be",
    "VBZ": "is has does says",
    "VBP": "am are have do",
    "VBD": "was were had did said went came made",
    "VBN": "been done gone",
    "VBG": "being having",
    "RB": "not very also never always just now then here there too again often still only even "
    "soon well",
    "WRB": "when where why how",
}

# Fixed values: (suffix, fine tag), first match wins.
SUFFIX_TAGS = [
    ("ly", "RB"),
    ("ing", "VBG"),
    ("ed", "VBD"),
    ("ous", "JJ"),
    ("ful", "JJ"),
    ("ive", "JJ"),
    ("able", "JJ"),
    ("ible", "JJ"),
    ("al", "JJ"),
    ("ish", "JJ"),
    ("s", "NNS"),
]
OTHER_TAG = "NN"

# Fine tags counted by each feature column.
TAG_GROUPS = {
    "adjective_count": ["JJ", "JJR", "JJS"],
    "adverb_count": ["RB", "RBR", "RBS", "WRB"],
    "noun_count": ["NN", "NNS", "NNP", "NNPS"],
    "verb_count": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD"],
    "conjunction_count": ["CC"],
    "pronoun_count": ["PRP", "PRP$", "WP", "WP$"],
    "present_tense_count": ["VBG", "VBP", "VBZ"],
    "past_tense_count": ["VBD", "VBN"],
}


def _by_tag(word: Column, value: dict[str, object]) -> Column:
    """`value` of the word's tag: closed classes first, then suffix rules."""

    def case(tests: list[tuple[Column, str]]):
        rule = None
        for test, tag in tests:
            out = F.lit(value[tag])
            rule = F.when(test, out) if rule is None else rule.when(test, out)
        return rule

    known = case([(word.isin(words.split()), tag) for tag, words in TAG_WORDS.items()])
    rules = case([(word.endswith(suffix), tag) for suffix, tag in SUFFIX_TAGS])
    closed = [w for words in TAG_WORDS.values() for w in words.split()]
    # One set test sends most words straight to the suffix rules.
    return F.when(word.isin(closed), known).otherwise(rules.otherwise(F.lit(value[OTHER_TAG])))


ALL_TAGS = {*TAG_WORDS, *(tag for _, tag in SUFFIX_TAGS), OTHER_TAG}


def fine_tag(word: Column) -> Column:
    """Tag of one lower-case word."""
    return _by_tag(word, {tag: tag for tag in ALL_TAGS})


def tag_bits() -> dict[str, int]:
    """For each tag a number with one bit per feature column that counts it."""
    return {tag: sum(1 << i for i, group in enumerate(TAG_GROUPS.values()) if tag in group) for tag in ALL_TAGS}


def feature_bits(token_array: Column) -> Column:
    """For each token a number with one bit per feature column that counts it."""
    bits = tag_bits()
    return F.transform(token_array, lambda t: _by_tag(t, bits))
