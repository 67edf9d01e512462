"""Alphabets, suffix lists and patterns: the one source for columns, the driver-side twin and oracle SQL."""

from __future__ import annotations

# Results depend on these exact letters and suffixes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
LOWER = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"
VOWELS = "аеиоЁЄІЇёєљ"
GERUND = "вшись|вши|в"
ADJECTIVE = "ее|ие|ые|ое|его|ого|ему|ому|их|ых|им|ым|ей|ой|ую|ая|яя|ою|ею|ими|ыми|ый|ий"
PARTICIPLE = "вш|ющ|щ"
VERB = "ла|ли|ло|л|ет|ует|ит|ыл|ейте|ите|ть|ться"
NOUN = "а|я|ев|ей|и|ов|ом|ем|ам|ям|ь"
SUPERLATIVE = "ейш|айш"

TOKEN_SPARK = "[0-9A-Za-z\\-Ѐ-ѿ]+"
TOKEN_DUCK = "[0-9A-Za-z\\-\\x{0400}-\\x{047F}]+"
#: A token takes one more character only while it is shorter than this many bytes.
MAX_TOKEN_BYTES = 254

#: "after the first vowel" and "after а or я".
IN_REGION = f"^([^{VOWELS}]*[{VOWELS}].*)"
AFTER_A = f"^([^{VOWELS}]*а|[^{VOWELS}]*[{VOWELS}].*[ая])"

#: (pattern, text put after group 1) in the order they run; ADJECTIVE alone gates PARTICIPLE.
S_GERUND = f"{AFTER_A}(?:{GERUND})$"
S_ADJECTIVE = f"{IN_REGION}(?:{ADJECTIVE})$"
S_PARTICIPLE = f"{AFTER_A}(?:{PARTICIPLE})$"
S_VERB = f"{AFTER_A}(?:{VERB})$"
S_NOUN = f"{IN_REGION}(?:{NOUN})$"
S_SUPERLATIVE = f"{IN_REGION}(?:{SUPERLATIVE})$"
S_DOUBLE_N = f"{IN_REGION}нн$"
S_SOFT = f"{IN_REGION}ь$"
TAIL = ((S_VERB, ""), (S_NOUN, ""), (S_SUPERLATIVE, ""), (S_DOUBLE_N, "н"), (S_SOFT, ""))

INVALID = ("^([0-9]+|-+)$", "^-|-$")
