"""DataFrame-to-DataFrame operators over panels, scores, reviews and text."""
