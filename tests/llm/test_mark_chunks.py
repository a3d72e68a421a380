"""Chunks of word marks alone are held against the library too."""

import pytest
from seriesmill.llm import sentencepiece_bpe
from seriesmill.llm.queries import piece_model


def test_marks_alone_are_checked():
    agenda = sentencepiece_bpe.Agenda(piece_model())
    agenda.encode([f"word{' ' * k}" for k in range(1, 120)] + ["   ", " "])
    agenda.check([])
    c = sentencepiece_bpe.MARK * 3
    agenda.unchecked.append((c, [5], c))
    with pytest.raises(ValueError, match="word marks"):
        agenda.check([])
