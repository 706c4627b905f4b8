"""meridian.functions"""
