"""Token ids of whole texts, as the tokenizers library gives them for a byte-level BPE file.

A file whose merges stand in the order of their ids is the same thing as a table of ranks, which a faster encoder takes. What the
file has besides (other kinds of models, several added tokens, added tokens with conditions) goes to the library itself, and so do
texts that the faster encoder's pattern search gives up on (over half a million white-space characters in a row).
"""

from __future__ import annotations

import json

import numpy as np

ID = np.dtype("<u4")


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id, if ranks say the same as the file's merges."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
    vocab, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(p)] for p in pairs]
    own = {t: i for t, i in vocab.items() if t not in added}
    if made != sorted(set(made)) or len(made) + 256 != len(own) or {t for t in own if len(t) == 1} != set(byte) or (made and made[0] <= max(own[t] for t in byte)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in own.items()}


class TextEncoder:
    """ids(text): the ids of a whole text as little-endian 32-bit numbers; largest: the largest id there is."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.largest = max(self.library.get_vocab(with_added_tokens=True).values())
        added = spec["added_tokens"]
        ranks = _ranks(spec) if len(added) <= 1 and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) else None
        self.fast, self.added = None, {t["content"] for t in added}
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("of a file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})._core_bpe

    def ids(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return bytes(self.fast.encode_to_tiktoken_buffer(text, self.added))
            except ValueError:  # the pattern search has a bound
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, ID).tobytes()


_ENCODERS: dict[str, TextEncoder] = {}


def json_encoder(path: str) -> TextEncoder:
    """Of a file of the tokenizers library; one a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
