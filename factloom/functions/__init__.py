"""factloom.functions"""
