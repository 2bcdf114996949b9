"""DataFrame operators over sampled series, frames, beats and slices."""
