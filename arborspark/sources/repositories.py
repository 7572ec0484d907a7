"""Repositories on the driver: shallow clones, branches and updates through the git command, before Spark sees any file."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.request import urlopen


@dataclass(frozen=True)
class Result:
    success: bool
    output: str
    error: str


def git(*args: str, cwd: str | None = None, timeout: float = 600) -> Result:
    """Never asks for a password; a missing command or too long a run is a failure with a message."""
    environment = os.environ | {"GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    try:
        done = subprocess.run(["git", *args], cwd=cwd, env=environment, capture_output=True, text=True, errors="replace", timeout=timeout)
    except subprocess.TimeoutExpired:
        return Result(False, "", "timed out")
    except OSError as e:
        return Result(False, "", str(e))
    return Result(done.returncode == 0, done.stdout, done.stderr)


def clone(url: str, folder: str, branch: str | None = None) -> Result:
    """One commit deep."""
    return git("clone", "--depth", "1", *(["--branch", branch] if branch else []), "--", url, folder)


def branch_lines(folder: str) -> list[str]:
    """Lines for ``gitparse.branches``: the remote's heads, or what is known of them if it can't be reached."""
    heads = git("ls-remote", "--heads", "origin", cwd=folder, timeout=60)
    found = heads.output if heads.success and heads.output.strip() else git("branch", "-r", cwd=folder).output
    return [x for x in found.splitlines() if x.strip()]


def current_branch(folder: str) -> str | None:
    name = git("rev-parse", "--abbrev-ref", "HEAD", cwd=folder).output.strip()
    return None if name in ("", "HEAD") else name


def local_branches(folder: str) -> list[str]:
    return [x for x in git("for-each-ref", "--format=%(refname:short)", "refs/heads", cwd=folder).output.splitlines() if x.strip()]


def fetch(url: str, target: str) -> None:
    """Writes what is at an address to a file; raises ``urllib.error.HTTPError`` with the server's code."""
    with urlopen(url, timeout=600) as source, open(target, "wb") as out:  # noqa: S310
        shutil.copyfileobj(source, out)


def download(addresses: list[str], target: str, fetch: Callable[[str, str], None] = fetch) -> str | None:
    """The first of the addresses that is there (the archives of main and master, say), written to ``target``; None if none is.

    Only a missing file (code 404) leads to the next address; other errors are raised.
    """
    for url in addresses:
        try:
            fetch(url, target)
        except HTTPError as e:
            if e.code != 404:
                raise
            continue
        return url
    return None


def head(folder: str) -> str | None:
    return git("rev-parse", "HEAD", cwd=folder).output.strip() or None


def default_branch(folder: str) -> str | None:
    """What the remote's HEAD points to."""
    return git("symbolic-ref", "--short", "refs/remotes/origin/HEAD", cwd=folder).output.strip().removeprefix("origin/") or None


def switch(folder: str, branch: str) -> Result:
    """Checks a branch out, fetching it first if it isn't there yet."""
    local = git("checkout", branch, cwd=folder)
    if local.success:
        return local
    fetched = git("fetch", "--depth", "1", "origin", f"refs/heads/{branch}:refs/remotes/origin/{branch}", cwd=folder)
    return git("checkout", "-B", branch, f"refs/remotes/origin/{branch}", cwd=folder) if fetched.success else fetched


def pull(folder: str) -> Result:
    return git("pull", "--ff-only", cwd=folder)
