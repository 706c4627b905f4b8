"""meridian.streaming"""
