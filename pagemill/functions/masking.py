"""Masking of personal information as a chain of regular expressions, JVM-side.

Rules run in order on rendered text. Digits are guarded by lookarounds, never by word boundaries, so a number glued to
Hangul is found, and two numbers one space apart are both found. Masking is not perfect: a person must check a result
before it is published.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: What stays of the match; ``$1`` is a label that led to it.
    token: str


# Label words, mobile and area prefixes, and number shapes of Korean documents.
NAME_LABELS = "이름|성명|성함|담당자|작성자|예금주|대표자|신청인|보호자"
BANK_LABELS = "국민은행|신한은행|우리은행|하나은행|농협은행|기업은행|국민|신한|우리|하나|농협|기업|새마을금고|우체국|카카오뱅크|토스뱅크|케이뱅크|계좌번호|계좌"

# Begins where a run of its characters does, or where the address before ended: two glued ones are both found.
EMAIL = Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]")
US_PHONE = Rule("phone", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]")
CARD = Rule("account", r"(?<![0-9])[0-9]{16}(?![0-9])", "[ACCOUNT]")
IP = Rule("ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "[IP]")

#: Rules that go by the form alone in any language. The Korean ones also meet digits inside hex secrets and cut-off numbers.
PLAIN: tuple[Rule, ...] = (EMAIL, US_PHONE, CARD, IP)

RULES: tuple[Rule, ...] = (
    EMAIL,
    US_PHONE,
    Rule("resident_number", r"(?<![0-9])[0-9]{6}[ ]?-[ ]?[1-8][0-9]{6}(?![0-9])", "[RRN]"),
    CARD,
    Rule("account", r"(?<![0-9-])[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}(?![0-9-])", "[ACCOUNT]"),
    Rule("phone", r"(?<![0-9])(?:\+82[ -]?1|01)[016789][ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])", "[PHONE]"),
    Rule("phone", r"(?<![0-9])(?:\(0(?:2|[3-6][0-9]|70)\)[ ]?|0(?:2|[3-6][0-9]|70)[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])", "[PHONE]"),
    Rule("account", rf"({BANK_LABELS})([^0-9\n]{{0,12}})[0-9]{{2,6}}(?:-[0-9]{{2,8}}){{1,3}}(?![0-9])", "$1$2[ACCOUNT]"),
    Rule("account", r"(?<![0-9-])[0-9]{3,6}-[0-9]{2,6}-[0-9]{5,8}(?![0-9-])", "[ACCOUNT]"),
    IP,
    Rule("name", rf"({NAME_LABELS})([ \t]*[:：|][ \t|]*|[ \t]+)(?!\[)[가-힣]{{2,4}}(?![가-힣])", "$1$2[NAME]"),
)


def mask(text: Column, on: bool = True, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every rule applied in order; unchanged where the switch is off."""
    for rule in rules if on else ():
        text = F.regexp_replace(text, F.lit(rule.pattern), F.lit(rule.token))
    return text


def times(text: Column, token: str) -> Column:
    """How often a token stands in the text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)


def hits(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, n>>: how often each kind was masked."""
    tokens = {rule.kind: rule.token.rpartition("[")[1] + rule.token.rpartition("[")[2] for rule in rules}
    # The masked text is made once, as the only element of an array. No rule takes a token away again.
    each = lambda masked: F.array(*[F.struct(F.lit(kind).alias("kind"), (times(masked, token) - times(text, token)).cast("long").alias("n")) for kind, token in tokens.items()])
    return F.element_at(F.transform(F.array(mask(text, rules=rules)), each), 1)
