"""Identity keys: base and source ids, paths, synonyms, hash seeds, bit signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The augmentation suffixes and the source form that file names carry, and the synonyms of split names.
AUGMENTATION = r"[_\-.](?:r(?:90|180|270)|rot(?:ate)?[_-]?(?:90|180|270)|fh|fv|hflip|vflip|brt|brightness(?:[_-]?[0-9.]+)?|flip[_-]?[hv])"
SOURCE = r"^((?:esp|psp|tra)_\d{6}_\d{4})_red-\d+$"
SPLIT_SYNONYMS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}


def casefold(x: Column) -> Column:
    """Text as it is compared without case, sharp s and ligatures written out; as Unicode folds it but for Cherokee letters."""
    # what upper case writes out, lower case would leave; the step between keeps the dotless i and makes one small sigma of both
    dotless, stands_in = "\u0131", "\ue000"
    return F.lower(F.translate(F.upper(F.translate(x, dotless, stands_in)), stands_in + "\u03a3", dotless + "\u03c3"))


def base_id(stem: Column) -> Column:
    """The stem without its augmentation suffixes, case-folded."""
    return casefold(F.regexp_extract(stem, f"(?i)^(.*?)((?:{AUGMENTATION})*)$", 1))


def augmentations(stem: Column) -> Column:
    """The stem's augmentation suffixes in order, lower-cased, without their separators."""
    tail = F.regexp_extract(stem, f"(?i)^(.*?)((?:{AUGMENTATION})*)$", 2)
    return F.transform(F.regexp_extract_all(tail, F.lit(rf"(?i)({AUGMENTATION})(?=[_\-.]|$)"), F.lit(1)), lambda x: F.lower(F.substring(x, 2, 1000)))


def source_id(base: Column) -> Column:
    """The source that a base id names, or null."""
    return F.nullif(F.regexp_extract(base, SOURCE, 1), F.lit(""))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def split_name(name: Column) -> Column:
    """A split's usual name, or null where it is none of the known ones."""
    known = F.create_map(*(F.lit(x) for kv in SPLIT_SYNONYMS.items() for x in kv))
    return F.element_at(known, casefold(F.trim(name)))


def seed(text: Column) -> Column:
    """A 32-bit seed: the first eight hex digits of the text's sha256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def salted(value: Column, salt: str = "42") -> Column:
    """The sha256 that orders values at random but for ever alike."""
    return F.sha2(F.concat(F.lit(salt), value.cast("string")), 256)


def group_digest(members: Column) -> Column:
    """Sixteen hex digits for a set of names: sha256 of the names, sorted and joined by line ends."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), 1, 16)


def signature_bits(values: Column) -> Column:
    """A string of 0s and 1s: where a vector's elements are positive."""
    return F.array_join(F.transform(values, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def bits_as_long(bits: Column) -> Column:
    """A 64-bit string as a long, by its halves, which never overflow."""
    high, low = (F.conv(F.substring(bits, at, 32), 2, 10).cast("long") for at in (1, 33))
    return F.shiftleft(high, 32).bitwiseOR(low)


def bit_block(x: Column, offset: int, width: int) -> Column:
    """Bits [offset, offset + width) of a long, counted from the lowest."""
    return F.shiftrightunsigned(x, offset).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
