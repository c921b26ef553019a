"""Sources: page files, label files, ground truth, vocabularies, datasets."""

from linework.sources.files import box_labels, ground_truth, image_files, lines_dataset, mask_files, vocabulary, word_frequencies
from linework.sources.multipage import PageSource, paged_files
from linework.sources.pages import PageError, decode_pages, decode_pnm, pdf_pages, valid_pages

__all__ = ["PageError", "PageSource", "box_labels", "decode_pages", "decode_pnm", "ground_truth", "image_files", "lines_dataset", "mask_files", "paged_files", "pdf_pages", "valid_pages", "vocabulary", "word_frequencies"]
