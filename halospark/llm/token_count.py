"""Token counts by a unigram segmentation whose dynamic programme is shared over a trie.

Pre-tokens are words with a leading mark. Each task inserts its distinct pre-tokens in a trie: a node stands for a prefix and
keeps the prefix's best score and the number of tokens on its best path. So scores are computed once for each shared prefix,
and a pre-token's count is its terminal node's."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Nodes of a task's trie and words whose counts it remembers; what is full is begun anew, which costs time, not results.
NODES, KNOWN = 1_200_000, 600_000
#: Log score of a byte token, of which a character outside the vocabulary takes one for each of its UTF-8 bytes.
BYTE = -20.0


def pieces_of(path: str = TOKENIZER) -> dict[str, float]:
    """Piece -> log score, of the vocabulary in path. It ranks its pieces, and the score is that of a Zipf law of the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    return {model.id_to_piece(k): -math.log(r + 2) for r, k in enumerate(usual)}


class UnigramTrie:
    """Best segmentations of all prefixes of the strings put in. Of equal scores the path with the longest last piece is taken."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.pieces, self.nodes, self.longest = pieces, nodes, max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.edges, self.score, self.tokens = {}, [0.0], [0]  # (node, character) -> node

    def count(self, text: str) -> int:
        """The number of tokens of text; 0 for an empty one."""
        if len(self.score) + len(text) > self.nodes:
            self.clear()
        node, path = 0, [0]
        edges, score, tokens, pieces = self.edges, self.score, self.tokens, self.pieces
        for end in range(1, len(text) + 1):
            char = text[end - 1]
            child = edges.get(edge := node * 0x110000 + ord(char))
            if child is None:
                n = len(char.encode("utf-8", "surrogatepass"))
                best, many = score[node] + n * BYTE, tokens[node] + n
                for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    s = pieces.get(text[start:end])
                    if s is not None and (s := s + score[path[start]]) >= best:
                        best, many = s, tokens[path[start]] + 1
                child = edges[edge] = len(score)
                score.append(best)
                tokens.append(many)
            node = child
            path.append(node)
        return tokens[node]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each row of docs: id, n_pretokens, n_tokens, n_bytes.

    Pre-tokens are runs of other than white space (as str.split() sees it) with a leading mark. Null and empty texts have
    none. Rows that repeat an id each get a row; an empty table gives an empty result. The vocabulary has a fixed size."""
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        trie, known = UnigramTrie(pieces.value), {}
        for b in batches:
            out = []
            for text in b.column(1):
                text = text.as_py() or ""
                words = Counter(text.split())
                if len(known) > KNOWN:
                    known.clear()
                for w in [w for w in words if w not in known]:
                    known[w] = trie.count(MARK + w)
                out.append((sum(words.values()), sum(n * known[w] for w, n in words.items()), len(text.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3))], names=["id", "n_pretokens", "n_tokens", "n_bytes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long, n_bytes long").withColumnRenamed("id", id_col)


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
