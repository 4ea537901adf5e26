"""What an HTML page says, by regular expressions that run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts that are no content.
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<head[^>]*>.*?</head>"
TAG = r"(?s)<[^>]*>"
GAP = r"[ \t\r\n]+"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def title(html: Column) -> Column:
    return F.regexp_extract(html, TITLE, 1)


def main_text(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " ")
    return F.trim(F.regexp_replace(bare, GAP, " "))
