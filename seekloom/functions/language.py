"""Language of a text by script and function words; no model to load."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Function words by two-letter code, most telling first.
FUNCTION_WORDS = {
    "en": "the and of to in is that it was for with as be", "de": "der die und das ist nicht ein eine zu den mit von auf", "fr": "le la les et des est une dans que qui pour pas du",
    "es": "el la los y que de las una por con para del se", "it": "il di che la e un per non sono della con gli una", "pt": "o que e do da em um para com uma os não no",
    "nl": "de het een en van dat niet te zijn op voor met aan", "sv": "och att det en som på är av för med den till inte", "da": "og at det en den til er som på de med af ikke",
    "no": "og i det på som en er til av for med at ikke", "fi": "ja on ei että se oli hän mutta ovat myös kuin niin joka", "et": "ja on ei et see ta oli ka kui aga mis ning oma",
    "pl": "i w nie na się że do to jest z jak ale po", "cs": "a se je na že to v s z ale jako pro by", "sk": "a sa je na že to v s z ale ako pre by som", "sl": "in je se da na za so ki pa ne bi kot še",
    "hr": "i je se da na u za su od ne što kao ali", "hu": "a az és hogy nem is egy van de meg ez csak volt", "ro": "și de la în a nu este pe cu că un o care", "tr": "ve bir bu da de için ile çok ne gibi daha olan var",
    "lt": "ir kad yra į ne su iš kaip bet tai buvo jis per", "lv": "un ir ka no ar uz par bet kā tas nav to arī", "is": "og að er í ekki það sem við en var til um hann", "id": "yang dan di untuk dengan ini itu dari tidak ke pada adalah dalam",
    "ca": "i de la que el els amb per les una no és dels", "ru": "и в не на что с по это как но он она из", "bg": "и на да се за от не в е са че това със", "sr": "и је да се на у за су од не што као али",
}
#: Scripts that one language of the list writes.
SCRIPTS = {"el": r"[Ͱ-Ͽ]", "iw": r"[֐-׿]", "ar": r"[؀-ۿ]", "ko": r"[가-힯]", "ja": r"[぀-ヿ]"}
#: Words and letters below which nothing is said.
LEAST_HITS = 2


def _table() -> dict[str, list[str]]:
    owners: dict[str, list[str]] = {}
    for code, listed in FUNCTION_WORDS.items():
        for word in listed.split():
            owners.setdefault(word, []).append(code)
    return owners


@F.pandas_udf(StringType())
def detect(texts: pd.Series) -> pd.Series:
    """Two-letter code, "" where neither script nor words tell; a tie goes to the code that sorts first.

    Every function word votes for the languages that have it, in Arrow batches: a
    column expression would go through the words once for each language.
    """
    owners, scripts = _table(), {code: regex.compile(p) for code, p in SCRIPTS.items()}
    letter, words = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+")

    def one(text: str | None) -> str:
        text = text or ""
        letters = len(letter.findall(text))
        for code, script in scripts.items():
            if letters and 2 * len(script.findall(text)) > letters:
                return code
        votes = Counter(code for w in words.findall(text.lower()) for code in owners.get(w, ()))
        hits, code = min(((-n, c) for c, n in votes.items()), default=(0, ""))
        return code if hits <= -LEAST_HITS else ""

    return texts.map(one)
