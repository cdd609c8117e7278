"""streaming of tabloom."""
