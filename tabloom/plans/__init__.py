"""plans of tabloom."""
