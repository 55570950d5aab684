"""The character rules as a table: patterns of a character and its neighbours, and what the character then means.

Rows are in the order of precedence: of the rows that match at a character the first one counts. A row without a status
says that the character means nothing there.
"""

from __future__ import annotations

from typing import NamedTuple

from labelsieve.sources import fixed


class Rule(NamedTuple):
    """pattern: the text; place: the character in it; back, ahead: how far the found word reaches; then what is found."""

    pattern: str
    place: int
    back: int = 0
    ahead: int = 0
    status: str = ""
    category: str = ""
    en: str = ""
    note: str = ""


SLAUGHTER = "permitted species; slaughter has to be known"


def _behind(others: list[str], char: str, *what) -> list[Rule]:
    """The character behind one of the others."""
    return [Rule(c + char, 1, *what) for c in others]


def _before(char: str, others: list[str], *what) -> list[Rule]:
    """The character before one of the others."""
    return [Rule(char + c, 0, *what) for c in others]


def _of_species(char: str, word: str) -> list[Rule]:
    return [Rule(c + char, 1, 2, 2, "meat", "meat", f"{name} {word}", SLAUGHTER) for c, name in fixed.SPECIES.items()]


def rule_rows() -> list[Rule]:
    alone = {*fixed.PORK, *fixed.FORBIDDEN_ANIMALS, "肉", "血", "骨", "酒", "胶", *fixed.SPECIES}
    return [
        *[Rule(word, k) for word in fixed.RULE_EXCEPTIONS for k, c in enumerate(word) if c in alone],
        *[Rule(c, 0, 1, 4, "haram", "pork", f"from pork ({c})", "anything of pig is pork") for c in fixed.PORK],
        *[Rule(c, 0, 1, 3, "haram", "animal", name, "animal that is not permitted") for c, name in fixed.FORBIDDEN_ANIMALS.items()],
        *_behind(fixed.MEAT_PLANT_PREFIX, "肉"),
        *_before("肉", fixed.MEAT_PLANT_SUFFIX),
        *_of_species("肉", "meat"),
        Rule("肉", 0, 2, 2, "likely", "meat", "meat of an unnamed species", "unnamed meat is mostly pork"),
        *_before("血", fixed.BLOOD_SKIP),
        *_behind(fixed.BLOOD_PREFIX, "血", 1, 2, "haram", "blood", "blood", "blood is not permitted"),
        Rule("血", 0, 1, 2, "review", "blood", "perhaps blood", "see what the character stands for"),
        *_before("骨", fixed.BONE_SKIP),
        *_behind(fixed.BONE_SKIP_BEFORE, "骨"),
        *_of_species("骨", "bone"),
        Rule("骨", 0, 2, 2, "likely", "meat", "bone of an unnamed species", "unnamed bone is mostly pork"),
        *_before("酒", fixed.LIQUOR_SKIP),
        Rule("酒", 0, 2, 2, "review", "alcohol", "perhaps alcohol", "see whether liquor is meant"),
        Rule("胶囊", 0, 1, 1, "doubtful", "gelatin", "capsule", "shells are gelatin unless a plant is named"),
        Rule("胶", 0, 2, 1, "review", "gelatin", "unknown gum or gel", "a plant gum or gelatin"),
        *[r for c in fixed.SPECIES for r in _before(c, fixed.SPECIES_SKIP)],
        *[Rule(c, 0, 1, 3, "meat", "meat", f"{name} (animal)", SLAUGHTER) for c, name in fixed.SPECIES.items()],
    ]
