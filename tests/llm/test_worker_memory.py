"""Workers share the executor's memory with its JVM and live on from stage to stage: what they remember is bounded."""

import tracemalloc

from wakelog.llm import pieces, quality
from wakelog.llm.queries import piece_vocabulary


def test_features_remember_little():
    """Pipeline, encode pieces: up to a million words stayed in a worker at some 300 bytes each before."""
    extract = quality.Features()
    tracemalloc.start()
    for i in range(400):
        extract.of(" ".join(f"w{i * 1000 + j}x" for j in range(1000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40_000_000


def test_forgotten_words_do_not_change_features(monkeypatch):
    text = " ".join(f"Word{i % 40}, {i % 7}" for i in range(500))
    places, values = quality.Features().of(text)
    monkeypatch.setattr(quality, "REMEMBERED", 3)
    again = quality.Features().of(text)
    assert (again[0] == places).all() and (again[1] == values).all()


def test_encoder_remembers_little():
    encoder = pieces.Encoder(piece_vocabulary())
    most = 0
    for i in range(60):
        encoder.arrays([" ".join(f"k{i * 5000 + j}" for j in range(5000))])
        most = max(most, encoder.held)
    assert most < 30_000_000
