"""Functions on addresses, file heads and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL = 2048


def normal_url(url: Column) -> Column:
    """A web address without its fragment; null if it isn't http or https on the usual ports, has no host, or is too long."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    port = F.regexp_extract(u, r"^[a-zA-Z]+://(?:[^/?@]*@)?(?:\[[^\]]*\]|[^/?:]*):(\d+)(?:[/?]|$)", 1)
    host = F.regexp_extract(u, r"^[a-zA-Z]+://(?:[^/?@]*@)?(\[[^\]]*\]|[^/?:]+)", 1)
    ok = F.lower(F.regexp_extract(u, r"^([a-zA-Z]+)://", 1)).isin("http", "https") & (F.length(u) <= MAX_URL) & (host != "") & port.isin("", "80", "443")
    return F.when(ok, u)


def image_type(head: Column) -> Column:
    """The kind of image that the first bytes of a file (binary) start like; null for anything else."""
    h = F.hex(head)
    return (
        F.when(F.startswith(h, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(h, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(h, F.lit("474946383761")) | F.startswith(h, F.lit("474946383961")), "image/gif")
        .when(F.startswith(h, F.lit("52494646")) & (F.substring(h, 17, 8) == "57454250"), "image/webp")
    )


def page_title(html: Column) -> Column:
    """The title of a page: what its head names for previews, else its title element, white space collapsed; null if none."""
    named = F.regexp_extract(html, r"""(?is)<meta[^>]+property\s*=\s*["']og:title["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    found = F.trim(F.regexp_replace(F.when(F.trim(named) != "", named).otherwise(plain), r"\s+", " "))
    return F.when(found != "", found)


def valid_repository(name: Column) -> Column:
    """owner/name of letters, digits, dots, underscores and dashes, neither part made of dots only."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~name.rlike(r"(^|/)\.+(/|$)"), F.lit(False))


def safe_path(path: Column) -> Column:
    """A relative path that doesn't leave its folder."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\x00")) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))
