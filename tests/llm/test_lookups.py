"""What op2's encoder does for a word that it knows."""

import public_tokenizers

from tracewright.llm.bitplane import WordEncoder


class Counted(dict):
    looked = 0

    def get(self, *a):
        self.looked += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.looked += 1
        return super().__getitem__(k)

    def __contains__(self, k):
        self.looked += 1
        return super().__contains__(k)


def test_a_known_word_is_looked_up_once():
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    texts = ["alpha beta\nalpha, Beta.", None, "", " gamma  alpha "]
    first = [x.tolist() for x in encoder.encode(texts)]
    encoder.codes = Counted(encoder.codes)
    again = [x.tolist() for x in encoder.encode(texts)]
    assert again == first and sum(first[1]) == len(first[0])
    assert encoder.codes.looked == 9  # as many as there are pieces between spaces and newlines
