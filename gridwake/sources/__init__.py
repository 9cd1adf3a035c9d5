"""Reading raw tables, articles and waveform archives; writing results."""
