"""Input rules: every violated one adds its message, joined by a comma."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark import vocab
from moodspark.functions.text import is_blank
from moodspark.operators.sentiment import SPACES

# Before the last at sign dot-separated words or quoted texts, after it labels or an address in brackets. Repeats are
# possessive, so a long address costs no stack.
_WORD = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\u0080-\uFFFF-]+"
_LABEL = r"[A-Za-z0-9\u0080-\uFFFF](?:[A-Za-z0-9\u0080-\uFFFF-]{0,61}[A-Za-z0-9\u0080-\uFFFF])?"
_QUOTED = r"\"(?:[A-Za-z0-9!#$%&'*.(),<>\[\]:; @+/=?^_`{|}~\u0080-\uFFFF-]|\\\\|\\\")++\""
_PART = rf"(?:{_WORD}|{_QUOTED})"
LOCAL = rf"^{_PART}(?:\.{_PART})*+$"
DOMAIN = rf"^(?:{_LABEL}(?:\.{_LABEL})*+|\[[0-9.]+\]|\[IPv6:[0-9A-Fa-f:.]+\])$"
LOCAL_LIMIT, DOMAIN_LIMIT = 64, 255

# Fixed value: the password rule.
PASSWORD = r"^(?=.*[A-Za-z])(?=.*\d)(?=.*[@$!%*#?&])[A-Za-z\d@$!%*#?&]{8,}$"


@dataclass(frozen=True)
class Rule:
    violated: Column
    message: str


def required(column: str, message: str) -> Rule:
    return Rule(is_blank(column), message)


def length_between(column: str, low: int, high: int, message: str) -> Rule:
    return Rule(~F.length(column).between(low, high), message)


def matches(column: str, pattern: str, message: str) -> Rule:
    return Rule(~F.col(column).rlike(pattern), message)


def email_format(column: str, message: str) -> Rule:
    c = F.col(column)
    domain = F.substring_index(c, "@", -1)
    local = F.substr(c, F.lit(1), F.greatest(F.length(c) - F.length(domain) - 1, F.lit(0)))
    # Lengths are looked at before the patterns.
    fits = c.contains("@") & (F.length(local) <= LOCAL_LIMIT) & (F.length(domain) <= DOMAIN_LIMIT)
    valid = F.when(fits, local.rlike(LOCAL) & domain.rlike(DOMAIN)).otherwise(F.lit(False))
    return Rule((c != "") & ~valid, message)


def diary_rules() -> list[Rule]:
    return [required("content", vocab.DIARY_CONTENT_REQUIRED)]


def nickname_rules() -> list[Rule]:
    return [
        required("nickname", vocab.NICKNAME_REQUIRED),
        length_between("nickname", 2, 20, vocab.NICKNAME_LENGTH),
    ]


def join_rules() -> list[Rule]:
    return [
        required("email", vocab.EMAIL_REQUIRED),
        email_format("email", vocab.EMAIL_FORMAT),
        required("password", vocab.PASSWORD_REQUIRED),
        length_between("password", 8, 20, vocab.PASSWORD_LENGTH),
        matches("password", PASSWORD, vocab.PASSWORD_PATTERN),
        *nickname_rules(),
    ]


def login_rules() -> list[Rule]:
    return [
        required("email", vocab.LOGIN_EMAIL_REQUIRED),
        email_format("email", vocab.EMAIL_FORMAT),
        required("password", vocab.LOGIN_PASSWORD_REQUIRED),
    ]


def text_rules() -> list[Rule]:
    """What a classifier is asked about must not be blank."""
    blank = F.col("text").isNull() | (F.btrim("text", F.lit(SPACES)) == "")
    return [Rule(blank, vocab.TEXT_REQUIRED)]


def with_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add `errors`: the joined messages, NULL for a valid row. A NULL value breaks only `required`."""
    found = [F.when(r.violated, F.lit(r.message)) for r in rules]
    return df.withColumn("errors", F.nullif(F.concat_ws(", ", *found), F.lit("")))


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones with their errors."""
    checked = with_errors(df, rules)
    return checked.where(F.col("errors").isNull()).drop("errors"), checked.where(F.col("errors").isNotNull())
