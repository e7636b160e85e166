"""spark-submit entry: new words of a folder of texts."""

from __future__ import annotations

import argparse
import logging
import logging.handlers


def setup_logging(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Console, and a file of 10 MB with five predecessors if a path is given."""
    log = logging.getLogger("marlstone")
    log.setLevel(level)
    if not log.handlers:
        shown = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        for h in [logging.StreamHandler(), *([logging.handlers.RotatingFileHandler(path, maxBytes=10 << 20, backupCount=5, encoding="utf-8")] if path else [])]:
            h.setFormatter(shown)
            log.addHandler(h)
    return log


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Find new words in the .txt files of a folder.")
    # The flags and their defaults.
    p.add_argument("--input_dir", "-i", required=True)
    p.add_argument("--output_file", "-o", default="new_words.txt")
    p.add_argument("--min_freq", type=int, default=5)
    p.add_argument("--min_pmi", type=float, default=3.0)
    p.add_argument("--min_entropy", type=float, default=1.0)
    p.add_argument("--top_k", type=int, default=200)
    a = p.parse_args(args)
    from marlstone.operators.newwords import new_words
    from marlstone.operators.sinks import write_report
    from marlstone.session import build_session, release
    from marlstone.sources.loaders import read_corpus

    spark = build_session("new-words")
    found = new_words(read_corpus(spark, a.input_dir), "content", a.min_freq, min_pmi=a.min_pmi, min_entropy=a.min_entropy, top_k=a.top_k)
    write_report(found, a.output_file, ["word", "freq", "score", "min_pmi", "min_entropy", "cohesion"])
    setup_logging().info("written to %s", a.output_file)
    release(spark)


if __name__ == "__main__":
    main()
