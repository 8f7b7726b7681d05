"""Language labels and what they mean."""

from __future__ import annotations

import re

# ISO 639 codes and names of languages a label may spell.
NAMES = {
    "en": "eng english anglais englisch inglés ingles engels",
    "de": "deu ger german deutsch allemand alemán duits",
    "fr": "fra fre french français francais französisch francés frans",
    "es": "spa spanish español espanol castellano spanisch espagnol",
    "nl": "nld dut dutch nederlands niederländisch flemish vlaams",
    "pt": "por portuguese português portugues portugiesisch brazilian",
    "it": "ita italian italiano", "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor norwegian norsk nb nob nn nno",
    "fi": "fin finnish suomi", "pl": "pol polish polski", "cs": "ces cze czech", "ru": "rus russian", "uk": "ukr ukrainian",
    "tr": "tur turkish", "el": "ell gre greek", "hu": "hun hungarian magyar", "ro": "ron rum romanian", "ca": "cat catalan",
    "ja": "jpn japanese", "zh": "zho chi chinese", "ko": "kor korean", "ar": "ara arabic", "he": "heb hebrew", "hi": "hin hindi",
    "la": "lat latin", "eo": "epo esperanto", "vi": "vie vietnamese", "id": "ind indonesian", "bg": "bul bulgarian", "hr": "hrv croatian",
    "sr": "srp serbian", "sk": "slk slo slovak", "sl": "slv slovenian", "et": "est estonian", "lv": "lav latvian", "lt": "lit lithuanian",
    "is": "isl ice icelandic", "ga": "gle irish", "fa": "fas per persian", "th": "tha thai",
}
_CODES = {word: code for code, words in NAMES.items() for word in (code, *words.split())}


def label_code(label: str | None) -> str | None:
    """Two-letter code of the language a label names, in any common spelling; None if it names none."""
    if not label:
        return None
    first = re.split(r"[\s_\-(,;/.]", label.strip().lower(), maxsplit=1)[0]
    return _CODES.get(first)


def label_expr(column: str):
    """label_code as a column expression."""
    from pyspark.sql import functions as F

    first = F.element_at(F.split(F.lower(F.trim(F.col(column).cast("string"))), r"[\s_\-(,;/.]"), 1)
    table = F.create_map(*[F.lit(x) for pair in sorted(_CODES.items()) for x in pair])
    return F.when(F.col(column).isNotNull(), F.try_element_at(table, first))
