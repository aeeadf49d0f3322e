"""Language labels in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-1 code -> other codes (ISO 639-2/3) and names of the language.
LABELS = {
    "en": "eng english inglés inglês anglais englisch 영어 英語", "ko": "kor korean coreano coréen koreanisch 한국어 韓国語 korea", "ja": "jpn japanese japonés japonês japonais japanisch 일본어 日本語",
    "es": "spa spanish español espanol castellano espagnol spanisch 스페인어", "pt": "por portuguese português portugues portugais portugiesisch 포르투갈어", "fr": "fra fre french français francais francés französisch 프랑스어",
    "id": "ind in indonesian indonesia indonesisch indonésien 인도네시아어", "de": "deu ger german deutsch alemán alemão allemand 독일어", "zh": "zho chi chinese mandarin cmn 中文 중국어", "it": "ita italian italiano",
    "nl": "nld dut dutch nederlands", "ru": "rus russian русский", "vi": "vie vietnamese", "th": "tha thai", "ms": "msa may malay melayu", "tl": "tgl tagalog fil filipino", "ar": "ara arabic", "hi": "hin hindi",
    "tr": "tur turkish türkçe", "pl": "pol polish polski", "sv": "swe swedish svenska",
}


def language_code(col: Column) -> Column:
    """Two-letter code of a label in any spelling; null for missing, blank, unknown-language or unreadable labels."""
    pairs = [x for code, names in LABELS.items() for name in (code, *names.split()) for x in (F.lit(name), F.lit(code))]
    word = F.element_at(F.split(F.lower(F.trim(F.regexp_replace(col, r"[\s ]+", " "))), r"[-_ (;,/.]"), 1)
    return F.try_element_at(F.create_map(*pairs), word)
