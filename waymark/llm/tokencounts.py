"""Token counts by a unigram model over pieces, with work shared among pre-tokens that begin alike.

A text's pre-tokens are its words between ASCII white space, each with the mark of a word's begin before it. The pieces are those of a
SentencePiece model file but for pure white space, which no pre-token has. The file is of a BPE model, whose scores are
ranks by frequency, so a piece of rank r gets the log probability of Zipf's law, ``-log(r) - log(sum of 1 / r)``. A
segmentation's score is the sum of its pieces' log probabilities; a character that no piece
covers is spelled in byte pieces, at ``UNKNOWN`` below the least score for each character. The count of the best
segmentation counts; of equally good ones, the one with the fewest tokens.

Distinct pre-tokens that a task doesn't know yet are inserted in a trie. A node has the forward score of its prefix and the number of tokens of
the best segmentation, computed once, when the node is made, from the nodes on its path; the node at which a pre-token ends is a terminal, whose count
is stored. Trie and stored counts are bounded; when they are full a task begins anew, which costs work only.

Cases: null and empty texts have no tokens; white space has none; repeated rows get equal counts; ties are settled as said;
an empty table gives an empty one; a very long text is held once, and a very long word takes time
in proportion to its length times the longest piece; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import documents, python_batches, record, schemas, texts

BEGIN = "▁"
UNKNOWN = 10.0
#: Counts that a task stores, and nodes of its trie.
CACHE, NODES = 600_000, 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Log probabilities of a model's pieces, and the trie of pre-tokens."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        plain = [i for i in plain if model.id_to_piece(i) == BEGIN or model.id_to_piece(i).strip(BEGIN)]
        plain.sort(key=model.get_score, reverse=True)
        total = math.log(math.fsum(1 / r for r in range(1, len(plain) + 1)))
        self.score = {model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(plain, 1)}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - UNKNOWN
        self.terminals: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        #: By node: forward score and tokens of its prefix. Node 0 is the empty prefix.
        self.best, self.count = [0.0], [0]
        #: (node, next character) as one number to the node that follows.
        self.child: dict[int, int] = {}

    def insert(self, word: str) -> int:
        """The node of a pre-token (without its mark), made with those before it where they are missing."""
        token = BEGIN + word
        child, best, count, score, longest = self.child, self.best, self.count, self.score, self.longest
        path = [0]
        for end, char in enumerate(token, 1):
            edge = path[-1] << 21 | ord(char)
            node = child.get(edge)
            if node is None:
                s, last = score.get(char), path[-1]
                # A character without a piece costs as many tokens as it has bytes.
                top, n = (best[last] + s, count[last] + 1) if s is not None else (best[last] + self.unknown, count[last] + len(char.encode("utf-8", "surrogatepass")))
                for begin in range(end - 2, max(0, end - longest) - 1, -1):
                    s = score.get(token[begin:end])
                    if s is not None:
                        before = path[begin]
                        t = best[before] + s
                        if t > top or t == top and count[before] + 1 < n:
                            top, n = t, count[before] + 1
                node = child[edge] = len(best)
                best.append(top)
                count.append(n)
            path.append(node)
        return path[-1]

    def learn(self, words: set[bytes]) -> None:
        """Inserts pre-tokens and stores the counts of their terminals."""
        for w in sorted(words):
            if len(self.best) > NODES:
                self._clear()
            self.terminals[w] = self.count[self.insert(w.decode())]


@lru_cache(maxsize=2)
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path)


def count_tokens(df: DataFrame, text: str = "text", id_col: str = "doc_id", model: str | None = None) -> DataFrame:
    """``id_col``, n_pretokens, n_tokens and longest (tokens of the pre-token with most) of each row."""
    python_batches(df.sparkSession)
    kind, arrow = schemas(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint, longest bigint")

    def run(batches):
        own = pieces(model)
        for batch in batches:
            split = [t.encode().split() for t in texts(batch.column(1))]
            if len(own.terminals) > CACHE:
                own.terminals.clear()
            known = own.terminals
            new = {w for words in split for w in words if w not in known}
            if new:
                own.learn(new)
            get = known.__getitem__
            rows = []
            for words in split:
                n = list(map(get, words))
                rows.append((len(n), sum(n), max(n, default=0)))
            yield record(arrow, [batch.column(0), *(zip(*rows) if rows else [[]] * 3)])

    return df.select(id_col, text).mapInArrow(run, kind)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op4_token_counts": op4_token_counts}
