"""Embeds template strings from the command line: ``python -m motifmill.cli``."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from pathlib import Path

import numpy as np

from motifmill.operators.encoder import POOLING, Embedder, latest_checkpoint, resolve_vocabulary
from motifmill.sources.files import FORMATS, blank_free, infer_format

SIZES = ("small", "medium", "large")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motifmill-embed", description=__doc__)
    p.add_argument("smarts", nargs="*", help="template strings")
    p.add_argument("--file", "-f", help="a file with one string per line")
    p.add_argument("--weights", help="an .npz state (default: the latest in --models)")
    p.add_argument("--config", help="its JSON config (default: the file beside it)")
    p.add_argument("--vocab", help="the vocabulary JSON")
    p.add_argument("--models", default="models", help="the folder of checkpoints")
    p.add_argument("--size", choices=SIZES, default="medium", help="a subfolder of --models, if there is one")
    p.add_argument("--pooling", choices=POOLING, default="mean")
    p.add_argument("--device", default="cpu", choices=("cpu",))
    p.add_argument("--batch-size", type=int, default=64)
    p.add_argument("--max-length", type=int)
    p.add_argument("--output", "-o")
    p.add_argument("--format", choices=FORMATS)
    return p


def load(args: argparse.Namespace) -> Embedder:
    if args.config and not args.weights:
        raise FileNotFoundError("--config needs --weights")
    weights, config = args.weights, args.config
    if weights is None:
        own = Path(args.models) / args.size
        weights, config = latest_checkpoint(str(own if own.is_dir() else args.models))
    return Embedder.load(weights, config, resolve_vocabulary(args.vocab, str(Path(weights).with_name("vocab.json"))), args.pooling)


def write(texts: list[str], vectors: np.ndarray, output: str | None, fmt: str) -> None:
    if output:
        Path(output).parent.mkdir(parents=True, exist_ok=True)
    if fmt == "npy":
        np.save(output, vectors)
        return
    sink = open(output, "w", newline="") if output else sys.stdout
    try:
        if fmt == "json":
            json.dump([{"smarts": s, "embedding": v.tolist()} for s, v in zip(texts, vectors)], sink, indent=2)
            sink.write("\n")
        else:
            rows = csv.writer(sink)
            rows.writerow(["smarts", *(f"dim_{k}" for k in range(vectors.shape[1]))])
            rows.writerows([s, *v.tolist()] for s, v in zip(texts, vectors))
    finally:
        if output:
            sink.close()


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.smarts and args.file:
        p.error("give strings or --file, not both")
    fmt = infer_format(args.output, args.format)
    if fmt == "npy" and not args.output:
        p.error("the npy format needs --output")
    texts = args.smarts or blank_free(Path(args.file).read_text().splitlines() if args.file else sys.stdin.read().splitlines())
    if not texts:
        p.error("no strings were given")
    write(texts, load(args).predict(texts, args.max_length, args.batch_size), args.output, fmt)
    return 0


if __name__ == "__main__":
    sys.exit(main())
