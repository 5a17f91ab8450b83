"""Git as a bounded reader: no call runs hooks, filters or external programs, reads more than it may, or takes a revision
for an option."""

from __future__ import annotations

import re
import subprocess
import threading

OBJECT_ID = re.compile("[0-9a-f]{40}(?:[0-9a-f]{24})?")
METADATA_BYTES = 16 << 20
SECONDS = 300
#: Blobs and bytes of one cat-file call.
BLOBS, BLOB_BYTES = 64, 1 << 20
_SAFE = ("--no-pager", "--no-optional-locks", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-c", "core.quotePath=false")


class TooLarge(RuntimeError):
    """Git has more to say than may be read."""


def output(path: str, *args: str, most: int = METADATA_BYTES, given: bytes = b"", empty_if_missing: bool = False) -> bytes:
    """What git prints, of which no more than one byte beyond `most` is read."""
    run = subprocess.Popen(["git", *_SAFE, "-C", path, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    clock = threading.Timer(SECONDS, run.kill)
    clock.start()
    try:
        with run.stdin:
            run.stdin.write(given)
        out = run.stdout.read(most + 1)
        if len(out) > most:
            raise TooLarge(f"git {args[0]} printed more than {most} bytes")
        code = run.wait()
    finally:
        clock.cancel()
        run.kill()
        run.stdout.close()
        run.wait()
    if code == 1 and empty_if_missing and not out:
        return b""
    if code:
        raise RuntimeError(f"git {args[0]} failed")
    return out


def revision(path: str, name: str) -> str:
    """The full id of the commit that a name stands for; a name can't be an option."""
    found = output(path, "rev-parse", "--verify", "--quiet", "--end-of-options", name + "^{commit}", empty_if_missing=True).decode().strip()
    if not OBJECT_ID.fullmatch(found):
        raise RuntimeError("no such commit")
    return found


def batches(rows, size):
    """Runs of at most BLOBS rows and about BLOB_BYTES; a larger blob is a run of its own."""
    run, held = [], 0
    for r in rows:
        if run and (len(run) >= BLOBS or held + size(r) > BLOB_BYTES):
            yield run
            run, held = [], 0
        run.append(r)
        held += size(r)
    if run:
        yield run


def blobs(path: str, wanted: list[tuple[str, int]]) -> list[bytes]:
    """Contents of blobs by id and size, in one call; every header must repeat both."""
    if not wanted:
        return []
    out = output(path, "cat-file", "--batch", given="".join(oid + "\n" for oid, _ in wanted).encode(), most=sum(n + 128 for _, n in wanted))
    found, at = [], 0
    for oid, n in wanted:
        end = out.index(b"\n", at)
        if out[at:end] != b"%s blob %d" % (oid.encode(), n) or out[end + 1 + n : end + 2 + n] != b"\n":
            raise RuntimeError("a blob doesn't match its entry")
        found.append(out[end + 1 : end + 1 + n])
        at = end + 2 + n
    if at != len(out):
        raise RuntimeError("git printed more than the blobs")
    return found
