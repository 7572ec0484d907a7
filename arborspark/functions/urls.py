"""Repository URLs: checks, clean-up, web paths, names and archive addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOSTS = ("bitbucket.org", "codeberg.org", "git.sr.ht", "gitea.com", "github.com", "gitlab.com", "sourceforge.net")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^@/?#]*@)?([^/:?#]+)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def is_repository(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """http(s), and a known host or one below it, a path that ends in .git, or one with a segment git."""
    u = F.trim(url)
    host, path = _host(u), F.lower(_path(u))
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | F.endswith(host, F.lit(f".{h}"))
    return F.coalesce(u.rlike(r"^(?i)https?://[^/?#\s]+") & (known | F.endswith(path, F.lit(".git")) | F.contains(path, F.lit("/git/"))), F.lit(False))


def clean(url: Column) -> Column:
    """Without user, password, query, fragment, slashes at the end and .git."""
    u = F.regexp_replace(F.trim(url), r"[?#].*\z", "")
    u = F.regexp_replace(u, r"^([a-zA-Z]+://)[^@/]*@", "$1")
    return F.regexp_replace(F.regexp_replace(u, r"/+\z", ""), r"(?i)\.git\z", "")


def encode_segment(segment: Column) -> Column:
    """Percent-encoding that keeps the unreserved characters of RFC 3986 alone."""
    e = F.url_encode(segment)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def encode_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), encode_segment), "/")


def web_path(url: Column, relative: Column) -> Column:
    """A node's address: the clean URL for the root ('.'), below it the encoded path."""
    return F.when(relative == ".", clean(url)).otherwise(F.concat(clean(url), F.lit("/"), encode_path(relative)))


def repository_name(url: Column) -> Column:
    """The last segment of the clean URL's path, decoded; 'repository' if there is none."""
    last = F.regexp_extract(_path(clean(url)), r"([^/]+)/*\z", 1)
    return F.when(F.coalesce(last, F.lit("")) == "", "repository").otherwise(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))


def sanitised(name: Column) -> Column:
    """A file name without forbidden and control characters, of 100 at most, never empty."""
    s = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', ""))
    s = F.trim(F.substring(s, 1, 100))
    return F.when(F.coalesce(s, F.lit("")) == "", "repo").otherwise(s)


def archive_url(url: Column, branch: str = "main") -> Column:
    """The address of a GitHub repository's ZIP archive, null for other URLs."""
    m = r"^(?i)https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)"
    owner, repo = F.regexp_extract(F.trim(url), m, 1), F.regexp_replace(F.regexp_extract(F.trim(url), m, 2), r"(?i)\.git\z", "")
    return F.when((owner != "") & (repo != ""), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(f"/archive/refs/heads/{branch}.zip")))


def without_top_folder(entry: Column, top: Column) -> Column:
    """An archive entry's path below the archive's top folder, null for the folder itself; entries elsewhere, or of an archive without one, keep theirs."""
    path = F.translate(entry, "\\", "/")
    below = F.startswith(path, F.concat(top, F.lit("/")))
    rest = F.when(F.coalesce(below, F.lit(False)), F.substr(path, F.length(top) + 2)).otherwise(path)
    return F.when(rest != "", rest)


def archive_urls(url: Column) -> Column:
    """The addresses to try one after the other: of the branch main, then of master; null for URLs without an archive."""
    first = archive_url(url)
    return F.when(first.isNotNull(), F.array(first, archive_url(url, "master")))


def export_name(title: Column, suffix: str, extension: str) -> Column:
    """``<title>_<suffix>.<extension>`` for an exported file; characters that names can't have become '_'."""
    base = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "project").otherwise(title)
    return F.concat(F.regexp_replace(base, r"[/\x00]", "_"), F.lit(f"_{suffix}.{extension}"))


def in_cache(path: Column, cache: Column) -> Column:
    """Whether a path begins with the cache's, in any case; there is no check for a separator."""
    return F.startswith(F.upper(path), F.upper(cache))
