"""The layers: each module turns frames of one layer into frames of the next."""
