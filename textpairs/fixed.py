"""Defaults and constants whose values must equal the reference's for the
same results.  Everything else is derived from these or from a rule.
"""

# Fixed values (in the reference's order).
SPECIALS = ("<unk>", "<eos>", "<bos>", "<pad>")  # special tokens, ids 0, 1, 2, 3
UNK, EOS, BOS, PAD = 0, 1, 2, 3
SEQUENCE_LENGTH = 200  # positions of the model; questions <= 200 ids, answers <= 201 ids
BATCH_SIZE = 32

TRAIN_NUM, TRAIN_DEN = 4, 5  # train share 0.8 = int(0.8 * n) rows
WHISKER_IQR = 1.5  # box-plot whisker reach, in inter-quartile ranges
MODULE_SUFFIX_LEN = 4  # module name = file name without its last four characters
