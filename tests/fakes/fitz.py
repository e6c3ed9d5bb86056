"""A stand-in for the decoder: documents are JSON files."""

import json
import uuid
from pathlib import Path


class Rect:
    def __init__(self, *box):
        self.x0, self.y0, self.x1, self.y1 = box[0] if len(box) == 1 else box
        self.width, self.height = self.x1 - self.x0, self.y1 - self.y0


class Matrix:
    def __init__(self, a, d):
        self.a, self.d = a, d


class Pixmap:
    def __init__(self, text, samples):
        self.text, self.samples = text, samples

    def tobytes(self, kind):
        return f"{kind}:{self.text}".encode()


class Page:
    def __init__(self, raw):
        self.raw, self.rect = raw, Rect(0, 0, 600, 800)

    def get_text(self, kind):
        if kind == "dict":
            if self.raw.get("broken"):
                raise ValueError("no layout")
            return {"blocks": [{**b, "image": b["image"].encode()} if b.get("image") else b for b in self.raw.get("blocks", [])]}
        return self.raw["text"]

    def get_links(self):
        return [{**x, "from": Rect(x["from"])} for x in self.raw.get("links", [])]

    def get_textbox(self, rect):
        return f" at {rect.x0:g} "

    def get_pixmap(self, matrix, alpha, clip=None):
        blank = clip is not None and clip.y0 > 400
        return Pixmap(f"{self.raw['text']}@{matrix.a:.2f}" + (f" {clip.y0:g}-{clip.y1:g}" if clip else ""), bytes([7] * 50) if blank else bytes(range(50)))


class open:  # noqa: A001
    def __init__(self, path=None, stream=None, filetype=None):
        if stream is not None:
            self.raw = json.loads(bytes(stream))
        else:
            with __builtins__["open"](path) if isinstance(__builtins__, dict) else __builtins__.open(path) as f:
                self.raw = json.load(f)
        self.metadata = self.raw.get("metadata")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __len__(self):
        return len(self.raw["pages"])

    def __getitem__(self, n):
        if "seen" in self.raw:  # pages that were decoded leave a file
            Path(self.raw["seen"], f"{n}-{uuid.uuid4().hex}").touch()
        return Page(self.raw["pages"][n])

    def get_toc(self, simple):
        return self.raw.get("toc", [])
