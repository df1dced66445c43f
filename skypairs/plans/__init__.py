"""Whole jobs: a catalogue and a few settings in, a small result table out."""
