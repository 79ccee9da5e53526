"""Token ids of whole texts, inside tasks.

The vocabulary file is that of the ``tokenizers`` library. Its ids are computed by ``tiktoken`` from the same
vocabulary, several times faster, wherever both are known to agree: texts of old, settled code points
without very long unbroken runs. All other texts go through ``tokenizers`` itself.
"""

import json
import os
import re
from functools import lru_cache

import numpy as np

# Split pattern of byte-level vocabularies; fixed by the file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_RUN = 1500
# Latin, Cyrillic, punctuation, kana, common ideographs, Hangul: the same letters in all Unicode versions in use
_SETTLED = re.compile("[\x00-ͯЀ-ԯ -⁯ぁ-ゖァ-ヺ一-龥가-힣]*")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def _encoders(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    letters = _byte_of_letter()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return fast, Tokenizer.from_file(path)


def _has_long_run(raw: bytes) -> bool:
    if len(raw) < LONG_RUN:
        return False
    space = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return int(np.diff(edges, prepend=-1, append=len(raw) - 1).max()) >= LONG_RUN


def token_ids(raw: bytes | None, path: str) -> np.ndarray:
    """Ids of a UTF-8 text as 32-bit integers; null and empty texts have none."""
    if not raw:
        return np.empty(0, dtype=np.uint32)
    fast, exact = _encoders(path)
    text = raw.decode("utf-8")
    if _SETTLED.fullmatch(text) and not _has_long_run(raw):
        return fast.encode_to_numpy(text, allowed_special="all")
    return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
