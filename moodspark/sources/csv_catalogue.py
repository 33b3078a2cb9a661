"""The catalogue's seed file: emotion, category, title, description, image and content address per line."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.functions.text import java_trim

COLUMNS = ["emotion", "category", "title", "description", "image_url", "content_url"]

# A field is plain text and quoted sections in any mix; a section ends at a lone quote or at the end of the
# line. Possessive quantifiers keep long lines off the call stack.
_SECTION = r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)'
_FIELD = r',((?:[^",]++|"[^"]*+(?:""[^"]*+)*+(?:"|$))*+)'


def parse_catalogue_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Catalogue columns from CSV lines; other columns stay.

    Blank lines and lines of fewer than six fields are dropped, further fields are ignored. A quote that
    is left around one of the last four fields is taken off; a field of one quote spoils its line.
    """
    text = F.col(line)
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_FIELD), F.lit(1))
    plain = F.transform(
        raw, lambda f: java_trim(F.replace(F.regexp_replace(f, _SECTION, "$1"), F.lit('""'), F.lit('"')))
    )
    kept = F.filter(F.array(plain), lambda f: (F.size(f) >= 6) & ~F.exists(F.slice(f, 3, 4), lambda v: v == '"'))
    rows = lines.where(java_trim(text) != "").withColumn("_fields", F.explode(kept))
    for i, name in enumerate(COLUMNS):
        field = F.col("_fields")[i]
        inner = F.substr(field, F.lit(2), F.length(field) - 2)
        quoted = field.startswith('"') & field.endswith('"')
        rows = rows.withColumn(name, F.when(quoted, inner).otherwise(field) if i >= 2 else field)
    for name in ["image_url", "content_url"]:
        rows = rows.withColumn(name, F.nullif(name, F.lit("")))
    return rows.drop("_fields", *([line] if line not in COLUMNS else []))


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read seed files. Each line arrives whole, as one column, so that quotes are judged by our rules only."""
    lines = (
        spark.read.schema("line string")
        .options(header=True, sep="\u0001", quote="", escape="", comment="", maxCharsPerColumn=-1)
        .csv(path)
    )
    return parse_catalogue_lines(lines)
